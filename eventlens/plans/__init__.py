"""Composition: from raw tables to models, and from models to results."""

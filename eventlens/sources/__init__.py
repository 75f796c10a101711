"""Reading, flattening, ingesting and writing."""

"""eventlens: product analytics over web and app events, as Spark DataFrame jobs."""

from eventlens.config import Config

__all__ = ["Config"]

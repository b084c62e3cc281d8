"""Slowly changing dimensions on Spark: histories of types 0, 1 and 2, joins through time, watermarked
sources and data-quality assertions, as functions from DataFrames to DataFrames."""

from .config import ConfigError, ScdConfig
from .table import ScdTable

__all__ = ["ConfigError", "ScdConfig", "ScdTable"]

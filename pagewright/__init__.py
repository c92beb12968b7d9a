"""Spark-native data work around document text extraction."""

from pagewright.config import Config
from pagewright.facade import Batch, Engine

__all__ = ["Batch", "Config", "Engine"]

"""hearthline: building-heating telemetry analytics expressed as Spark DataFrames."""

from hearthline.config import HeatConfig

__all__ = ["HeatConfig"]

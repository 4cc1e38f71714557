"""barlake: perpetual-futures time series as PySpark DataFrame operations."""

from barlake.settings import configure, shared_dir

__all__ = ["configure", "shared_dir"]

"""txtrail: provenance of database changes by business transaction, on Spark."""

from txtrail.options import TrailOptions
from txtrail.streaming.app import Trail, build, run

__all__ = ["Trail", "TrailOptions", "build", "run"]

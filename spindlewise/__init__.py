"""Drive-fleet reports as Spark DataFrame jobs over one table of daily drive records."""

from spindlewise.fleet import DriveFleet

__all__ = ["DriveFleet"]

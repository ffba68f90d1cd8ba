"""Intermediate tables in the shared folder the cluster names in spark.checkpoint.dir."""

from wearcast.session import written

__all__ = ["written"]

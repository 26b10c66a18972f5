"""Every query the library answers on the shared tables, with its comparison SQL."""

from pairspan.workloads import classification, files, relational, similarity, spi_frequency, spi_time  # noqa: F401
from pairspan.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

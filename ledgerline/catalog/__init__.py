"""The registered queries, each beside its SQL."""

from ledgerline.catalog import checks, inference, landing, rows, usage  # noqa: F401
from ledgerline.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

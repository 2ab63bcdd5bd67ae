"""One entry per operator over the tables of a data folder, with the SQL that
gives the same rows where SQL can express it."""

from hostlens.catalog.common import REGISTRY
from hostlens.catalog import (  # noqa: F401
    alerting,
    decoding,
    features,
    fitting,
    joins,
    outbox,
    reports,
    scans,
    scoring,
    streams,
    windows,
)

__all__ = ["REGISTRY"]

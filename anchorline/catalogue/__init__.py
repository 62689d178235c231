"""Every operator as a named query over the supplied tables, with its SQL check where one exists."""

from __future__ import annotations

from anchorline.catalogue import (  # noqa: F401  (importing registers the queries)
    aggregates,
    columns,
    joins,
    metric_queries,
    model_queries,
    preparation,
    run_queries,
    sampling,
    scans,
    sweep_queries,
)
from anchorline.catalogue.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

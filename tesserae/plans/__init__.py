"""Named queries over the driver tables, each with its SQL counterpart where SQL can say it."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import (  # noqa: F401
    join_queries,
    key_queries,
    learn_queries,
    mask_queries,
    metric_queries,
    report_queries,
    spatial_queries,
)

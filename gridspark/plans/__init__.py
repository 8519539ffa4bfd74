"""Registered queries over the example tables, each with its check where SQL can express one."""

from gridspark.plans import (  # noqa: F401
    color_queries,
    frame_queries,
    grid_queries,
    payload_queries,
    plan_queries,
    region_queries,
    stream_queries,
)
from gridspark.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

"""All queries: importing the modules registers them."""

from workload import diffs, edges, gating, inputs, runs  # noqa: F401
from workload.registry import QUERIES, SQL  # noqa: F401

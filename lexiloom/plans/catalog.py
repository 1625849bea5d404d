"""All registered queries and their SQL."""

from __future__ import annotations

from lexiloom.plans import feature_queries, report_queries, retrieval_queries, table_queries, text_queries  # noqa: F401
from lexiloom.plans.registry import QUERIES, SQL  # noqa: F401

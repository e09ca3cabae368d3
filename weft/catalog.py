"""The registered queries of the engine and their SQL twins."""

from __future__ import annotations

from weft.plans import conversation_queries, memory_queries, policy_queries, security_queries, store_queries, stream_queries, task_queries  # noqa: F401
from weft.plans.registry import ORACLE, QUERIES  # noqa: F401

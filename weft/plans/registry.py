"""Where queries register themselves, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def register(func):
        QUERIES[func.__name__] = func
        if oracle:
            ORACLE[func.__name__] = oracle
        return func

    return register

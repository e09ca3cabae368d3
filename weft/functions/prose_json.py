"""JSON found in prose: whole text, fenced block, then a scan for balanced braces."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"


def balanced(text: str, opening: str = "{") -> str | None:
    """The first balanced stretch that reads as JSON; brackets inside strings do not count."""
    closing = {"{": "}", "[": "]"}[opening]
    start = text.find(opening)
    while start >= 0:
        depth, quoted, i = 0, False, start
        while i < len(text):
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
                if depth == 0:
                    part = text[start : i + 1]
                    try:
                        json.loads(part)
                    except ValueError:
                        break
                    return part
            i += 1
        start = text.find(opening, start + 1)
    return None


@pandas_udf(StringType())
def _scan(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: balanced(t) if isinstance(t, str) else None)


@pandas_udf(StringType())
def _scan_list(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: (balanced(t, "[") or balanced(t)) if isinstance(t, str) else None)


def _object(text: Column, lists: bool) -> Column:
    text = F.trim(text)
    shaped = text.rlike(r"(?s)^\s*[\{\[]") if lists else text.rlike(r"(?s)^\s*\{")
    return F.when(shaped & F.try_parse_json(text).isNotNull(), text)


def from_prose(text, lists: bool = False) -> Column:
    """The JSON text of the first object in prose (``{}`` if none); only what the
    built-in parser cannot settle goes to Python."""
    text = F.col(text) if isinstance(text, str) else text
    fence = F.regexp_extract(text, FENCE, 1)
    quick = F.coalesce(_object(text, lists), _object(fence, lists))
    scanned = (_scan_list if lists else _scan)(F.when(quick.isNull(), text))
    return F.coalesce(quick, scanned, F.lit("[]" if lists else "{}"))


def strip_fence(text: str) -> str:
    found = re.search(FENCE, text)
    return found.group(1) if found else text

"""Glob patterns as regular expressions that Spark's rlike takes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` stay in one; all else is literal."""
    out = []
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return "^" + "".join(out) + "$"


def name_regex(glob: str) -> str:
    """Shell-style names: ``*`` and ``?`` match anything, ``[..]`` is a set."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + (glob[i : i + 1] in ("!", "]")) + (glob[i : i + 2] == "!]"))) > 0:
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            body = "^" + body[1:] if body.startswith("!") else body.replace("^", "\\^", 1) if body.startswith("^") else body
            out.append(f"[{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "^(?s:" + "".join(out) + ")$"


def matches_name(value: Column, glob: str) -> Column:
    return F.lit(True) if glob == "*" else value.rlike(name_regex(glob))


def matches_path(value: Column, glob: str) -> Column:
    return value.rlike(path_regex(glob))

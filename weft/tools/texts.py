"""Small tools over texts, one for each way a tool can run."""

from __future__ import annotations

from weft.operators.registry import declare


@declare(sql="concat(name, '-', cast(size as string))")
def label(name: str, size: int):
    """A name with its size."""
    return f"{name}-{size}"


@declare(risk="medium")
def initials(text: str):
    """The first letters of a text's words."""
    return "".join(w[0] for w in text.split())


@declare(risk="high")
def run_anything(command: str):
    """Never runs inside a plan."""


@declare(returns="n int, line string", table=True)
def numbered_lines(text: str):
    """The lines of a text."""
    for n, line in enumerate(text.split("\n") if text is not None else [], 1):
        yield n, line

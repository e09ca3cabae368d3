"""A calculator over columns of expressions: numbers, + - * / % **, signs, brackets."""

from __future__ import annotations

import ast
import operator
import re

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}
MOST_POWER = 10_000


def evaluate(expression: str | None) -> float | None:
    """The value of an expression; None where it holds anything but numbers and signs."""
    try:
        return float(_value(ast.parse((expression or "").strip(), mode="eval").body))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError, MemoryError):
        return None


def _value(node):
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    if isinstance(node, ast.UnaryOp) and type(node.op) in UNARY:
        return UNARY[type(node.op)](_value(node.operand))
    if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
        a, b = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow) and abs(b) > MOST_POWER:
            raise OverflowError
        return BINARY[type(node.op)](a, b)
    raise ValueError("not a number")


NUMBER = re.compile(r"(?<![\w.])(?:[0-9]{1,15}\.[0-9]{0,15}|\.[0-9]{1,15}|0|[1-9][0-9]{0,14})(?![\w.])")
_EXACT = 2.0**53


def _columns(node, values: list[np.ndarray], unsure: np.ndarray) -> np.ndarray:
    """The value of an expression for many rows, whose n-th number is ``values[n]``.

    Marks rows in ``unsure`` where doubles may not do as Python's numbers: division by zero,
    results beyond 2^53 and zeros, whose sign whole numbers do not have.
    """
    if isinstance(node, ast.Name):
        return values[int(node.id[1:])]
    if isinstance(node, ast.UnaryOp) and type(node.op) in UNARY:
        out = UNARY[type(node.op)](_columns(node.operand, values, unsure))
    elif isinstance(node, ast.BinOp) and type(node.op) in BINARY and not isinstance(node.op, ast.Pow):
        a, b = _columns(node.left, values, unsure), _columns(node.right, values, unsure)
        if isinstance(node.op, (ast.Div, ast.Mod)):
            unsure |= b == 0
        out = BINARY[type(node.op)](a, b)
    else:
        raise ValueError("row by row")
    unsure |= ~(np.abs(out) < _EXACT) | (out == 0)
    return out


def evaluate_all(expressions: pd.Series) -> np.ndarray:
    """``evaluate`` for a batch: expressions that differ in their numbers only are parsed once and
    computed by columns; what that cannot do exactly, and powers, are evaluated one by one."""
    texts = expressions.fillna("").astype(str).to_numpy()
    out = np.full(len(texts), np.nan)
    shapes: dict[str, tuple[list[int], list[list[str]]]] = {}
    for i, text in enumerate(texts):
        rows, numbers = shapes.setdefault(NUMBER.sub("\0", text), ([], []))
        rows.append(i)
        numbers.append(NUMBER.findall(text))
    for shape, (rows, numbers) in shapes.items():
        slow = np.ones(len(rows), bool)
        if len(rows) > 1 and shape.count("\0") == len(numbers[0]) and not any(c.isalpha() or c == "_" for c in shape):
            count = iter(range(len(numbers[0])))
            text = re.sub("\0", lambda _, count=count: f"n{next(count)}", shape.strip())
            try:
                with np.errstate(all="ignore"):
                    slow = np.zeros(len(rows), bool)
                    out[rows] = _columns(ast.parse(text, mode="eval").body, list(np.array(numbers, np.float64).T), slow)
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                slow = np.ones(len(rows), bool)
        for i in np.array(rows)[slow]:
            found = evaluate(texts[i])
            out[i] = np.nan if found is None else found
    return out


@pandas_udf(DoubleType())
def calculate(expressions: pd.Series) -> pd.Series:
    found = evaluate_all(expressions)
    return pd.Series(found).astype(object).where(~np.isnan(found), None)

"""Operator 1: mixing sources to target weights by the cube method.

A source's target over its size is the number of times the mix takes each of its
documents: whole copies, and a fraction that is an inclusion probability. The
cube method turns the fractions into zeros and ones: within a block of one
source, three open documents at a time move along the null space of the
balancing constraints (number of documents and number of words), up to a face of
the cube and in a random direction that keeps the expectation, so that both
totals stay as they are. Each block leaves two open documents and a few of all
sizes that it has set aside; they meet in the next round of blocks, until one
block a source remains. Its open documents, a few dozen, are the landing problem:
all roundings are tried if they are 14 or fewer, and else a greedy one is improved
by flipping up to three until none brings the source nearer to its target. Both
totals count there: a document too many or too few costs ``DOCUMENT`` mean sizes.

Blocks hold ``block`` documents whatever the source's size, so a large source
spreads over many tasks; only ids and sizes travel, never texts. All randomness
derives from hashes of ids and texts: reruns agree (rows without an id are told
apart by their place in the input).

Defined edge cases: a null text has size 0; null sources form one source, the
last; sources without words have target 0; rows that repeat an id count as rows
of their own, also where all columns are equal; ties of sizes or ids change
nothing; a very long text is one size among others, and when no rounding meets the
target, the nearest one stands; other columns, whatever their names, are carried
through ``mix`` and ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize

WEIGHTS, MOST, BLOCK, SPARE, DOCUMENT = (1, 2, 3), 3, 2000, 40, 0.02
_EPS = 1e-9


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size, row (column ``row``, or the place in the input) and mark, a hash of id and text."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    place = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select("doc_id", "source", size.alias("size"), place.alias("row"), F.xxhash64("text").alias("mark")).withColumn("mark", F.xxhash64(F.coalesce("doc_id", "row"), "mark"))


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs and target for each source.

    Shares by weight, cut at ``most`` sizes, with the excess shared again: every
    target is the smaller of its cap and weight times one common level.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every = Window.partitionBy()
    s = s.withColumn("turn", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(every) - capped) / (F.sum("w").over(every) - used))
    first = F.min(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("ratio", "level"))).over(every)["level"]
    return s.withColumn("common", first).select("source", "source_size", "n_docs", F.least("cap", F.col("common") * F.col("w")).alias("target"))


def flight(x: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Move ``x`` in place until at most two entries are neither 0 nor 1."""
    draws = iter(rng.random(2 * len(x) + 4))
    open_, todo = [], iter(np.flatnonzero((x > _EPS) & (x < 1 - _EPS)).tolist())
    v, z = x.tolist(), size.tolist()
    while True:
        while len(open_) < 3:
            i = next(todo, None)
            if i is None:
                break
            open_.append(i)
        if len(open_) < 3:
            break
        a, b, c = open_
        u = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
        if not any(u):
            u = (1, -1, 0)
        scale = max(map(abs, u))
        u = [t / scale for t in u]
        up = min((1 - v[i]) / t if t > 0 else -v[i] / t for i, t in zip(open_, u, strict=True) if t)
        down = min(v[i] / t if t > 0 else (v[i] - 1) / t for i, t in zip(open_, u, strict=True) if t)
        step = up if next(draws) * (up + down) < down else -down
        for i, t in zip(open_, u, strict=True):
            v[i] += step * t
            v[i] = 0.0 if v[i] < _EPS else 1.0 if v[i] > 1 - _EPS else v[i]
        open_ = [i for i in open_ if 0 < v[i] < 1]
    x[:] = v


def spare(size: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` indices spread over the sizes."""
    order = np.argsort(size, kind="stable")
    return order if len(order) <= most else order[np.linspace(0, len(order) - 1, most).astype(int)]


def land(x: np.ndarray, size: np.ndarray, due: float, count: float) -> None:
    """Round the open entries (few) so that words and documents come nearest to ``due`` and ``count``."""
    left = np.flatnonzero((x > 0) & (x < 1))
    if not len(left):
        return
    left = left[np.argsort(-size[left], kind="stable")]
    z = size[left].astype(float)
    gap, less = due - (float(x @ size) - float(x[left] @ z)), count - (float(x.sum()) - float(x[left].sum()))
    price = DOCUMENT * float(z.mean())

    def cost(words, documents):
        return np.abs(words) + price * np.abs(documents)

    if len(left) <= 14:
        bits = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        x[left] = bits[cost(bits @ z - gap, bits.sum(axis=1) - less).argmin()]
        return
    take = np.zeros(len(left), bool)
    for i, t in enumerate(z):
        take[i] = abs(gap - t) < abs(gap)
        gap, less = (gap - t, less - 1) if take[i] else (gap, less)
    i, j, k = (np.append(c, len(left)) for c in _threes(len(left)))
    while True:
        move = np.append(np.where(take, z, -z), 0.0)  # what a flip adds to the gap; the last flips nothing
        one = np.append(np.where(take, 1.0, -1.0), 0.0)
        after = cost(gap + move[i] + move[j] + move[k], less + one[i] + one[j] + one[k])
        best = int(after.argmin())
        if after[best] >= cost(gap, less) - 1e-9:
            break
        for c in (i[best], j[best], k[best]):
            if c < len(take):
                gap, less = gap + move[c], less + one[c]
                take[c] = not take[c]
    x[left] = take


def _threes(n: int):
    """Index triples of up to three different entries below ``n``; ``n`` itself stands for none."""
    i, j, k = np.indices((n + 1,) * 3).reshape(3, -1)
    ok = (i < n) & ((i < j) | (j == n)) & ((j < k) | (k == n)) & ~((j == n) & (k < n))
    return i[ok], j[ok], k[ok]


def _fly(final: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="b").sort_values(["mark", "size", "doc_id"], kind="stable", ignore_index=True)
        x, size = part["x"].to_numpy(np.float64).copy(), part["size"].to_numpy(np.int64)
        due, count = float(x @ size), float(x.sum())
        open_ = np.flatnonzero((x > _EPS) & (x < 1 - _EPS))
        later = open_[spare(size[open_], SPARE)] if len(open_) else open_
        held = x[later].copy()
        x[later] = 0  # these wait for the landing
        flight(x, size, np.random.default_rng(int(part["mark"].iloc[0]) & 0x7FFFFFFFFFFFFFFF))
        x[later] = held
        if final:
            land(x, size, due, count)
        return part.assign(x=x)

    return run


def copies(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """doc_id, source, size, row, source_size, target and copies (how often the mix takes the row)."""
    block = max(block, 4 * (SPARE + 2))  # each round must shrink
    sized = materialize(sizes(docs, row), "sizes")
    aim = targets(sized)
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(aim.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(per + F.lit(_EPS))
    rows = rows.select("doc_id", "source", "size", "row", "source_size", "target", "n_docs", whole.alias("whole"), F.greatest(per - whole, F.lit(0.0)).alias("x"), "mark")
    shape, n = rows.schema, F.col("n_docs")
    levels = 1
    count = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while count > block:
        count, levels = (SPARE + 2) * -(-count // block), levels + 1
    done, n = [], F.col("n_docs")
    for level in range(levels):
        final = level == levels - 1
        blocks = F.greatest(F.ceil(n / block), F.lit(1))
        cut = F.lit(0) if final else F.pmod(F.xxhash64("mark", F.lit(level)), blocks)
        flown = rows.withColumn("b", cut).groupBy("source", "b").applyInPandas(_fly(final), shape)
        rows = materialize(flown, "mix")
        if final:
            done.append(rows)
        else:
            done.append(rows.where("x <= 0 or x >= 1"))
            rows, n = rows.where("x > 0 and x < 1"), blocks * (SPARE + 2)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("doc_id", "source", "size", "row", "source_size", "target", (F.col("whole") + F.round("x").cast("long")).alias("copies"))


def op1(docs: DataFrame) -> DataFrame:
    got = copies(docs)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it.

    Rows get a number first and are written with it, so that each keeps its own
    number of copies, whatever its id.
    """
    row, times, copy = (fresh(docs, c) for c in ("mix_row", "mix_times", "mix_copy"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    n = copies(numbered, row=row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    rows = numbered.join(n, row)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)

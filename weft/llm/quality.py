"""Operator 5: quality rules, with built-in functions only.

Base rules reject a text with fewer than 50 words, or with more than half of its
words inside 3-word windows that the text holds twice or more. The method's
verdict is a log-likelihood ratio: words and word pairs are hashed into
``BUCKETS`` cells; one multinomial is counted on trusted documents and one on
the whole raw corpus; a text's score is the mean log ratio of its cells. Half of
the trusted documents are counted; the score that all but a share ``TAIL`` of the
other half reach is the threshold, and every document is held against it.

Trusted documents are all that are labelled with quality 1; their texts are written
once, so that the whole corpus meets the labels in one join only. Their ids are sent
as bitmaps, 32 MB at most; ids that are too scattered for that are joined as they are. The raw counts
cover all documents. The two tables of counts have a fixed number of cells, so
sending their ratio to every task is bounded whatever the corpus.

Windows are compared by 64-bit hashes within one text. Defined edge cases: a null
text has no words and fails; without trusted rows all ratios are zero and the
base rules decide; repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, release

BUCKETS, TAIL, SMOOTH = 10_007, 0.001, 0.5
MIN_WORDS, MOST_REPEATED = 50, 50
#: Bitmaps of 32,768 ids (4 KB each) that may be sent to every task.
BITMAPS = 8192
SYMBOLS = r"[#*$%&|<>]"


def _once(array: Column) -> Column:
    """The same array, computed once a row.

    Functions over arrays look into these arrays from inside, so an optimizer that
    put the expression there (it does, below a filter on the result) would compute
    it once an element. It does not move expressions through a generator.
    """
    return F.explode(F.array(array))


def _words(docs: DataFrame, *also: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *also, text.alias("text"), _once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"))


def _cell(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _next(i: Column) -> Column:
    """The word after the i-th; the last one pairs with the text's end, an empty word."""
    return F.coalesce(F.get("words", i + 1), F.lit(""))


def _marked(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The documents whose ids are in ``good``; texts are not shuffled where bitmaps of the ids are small enough to be sent to all."""
    bucket = F.bitmap_bucket_number("doc_id")
    if good.select(bucket).distinct().count() > BITMAPS:
        return docs.join(good, "doc_id", "left_semi")
    bits = good.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))
    at = F.bitmap_bit_position("doc_id")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = docs.join(F.broadcast(bits), bucket == F.col("bucket"))
    return held.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and counted (half of the ids are) of the documents labelled with quality 1."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    return materialize(_marked(docs.select("doc_id", "text"), good).withColumn("counted", half), "trusted")


def _counts(docs: DataFrame) -> list[int]:
    """How often the words and word pairs of all texts fall into each cell."""
    pair = F.transform("words", lambda w, i: F.array(_cell(w), _cell(w, _next(i))))
    cells = _words(docs).where(F.size("words") > 0).select(F.explode(pair).alias("p"))
    counts = [0] * BUCKETS
    for r in cells.select(F.explode("p").alias("cell")).groupBy("cell").count().collect():  # BUCKETS rows at most
        counts[r["cell"]] = r["count"]
    return counts


def ratios(docs: DataFrame, good: DataFrame) -> list[float]:
    """Log ratio of every cell: counted trusted documents against all."""
    kept = _counts(good.where("counted"))
    if not sum(kept):
        return [0.0] * BUCKETS
    raw = _counts(docs)
    a, b = sum(raw) + SMOOTH * BUCKETS, sum(kept) + SMOOTH * BUCKETS
    return [round(math.log((g + SMOOTH) / b) - math.log((r + SMOOTH) / a), 6) for r, g in zip(raw, kept, strict=True)]


def threshold(good: DataFrame, table: list[float]) -> float:
    """The score that all but a share ``TAIL`` of the trusted documents that were not counted reach, between two scores by their distance."""
    rows = _words(good.where("not counted")).where(F.size("words") >= MIN_WORDS)
    n = rows.count()
    if not n:
        return float("-inf")
    at = TAIL * (n - 1)
    low = [r["s"] for r in rows.select(score(table).alias("s")).orderBy("s").limit(int(at) + 2).collect()][int(at) :]  # a share TAIL of the rows
    return low[0] if low[0] == low[-1] else (int(at) + 1 - at) * low[0] + (at - int(at)) * low[1]


def score(table: list[float]) -> Column:
    """Mean log ratio over the cells of the column ``words`` (no words: 0)."""
    ratio = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded into one literal
    each = F.transform("words", lambda w, i: F.get(ratio, _cell(w)) + F.get(ratio, _cell(w, _next(i))))
    return F.when(F.size("words") > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (2 * F.size("words"))).otherwise(0.0)


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words."""
    windows = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.withColumn("w3", F.when(F.size("words") >= 3, F.slice(windows, 1, F.greatest(F.size("words") - 2, F.lit(1)))))
    dup = F.size(F.array_distinct("w3")) < F.size("w3")
    ordered = F.sort_array(F.transform("w3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s3", _once(F.when(dup, ordered)))
    twice = F.filter("s3", lambda e, k: (e["h"] == F.get("s3", k - 1)["h"]) | (e["h"] == F.get("s3", k + 1)["h"]))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    cover = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.size("at") > 0, cover), F.lit(0)).cast("long"))


def base(docs: DataFrame, *also: Column) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and ``also`` (over text and words)."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = _words(docs).withColumns({"lines": lines, "n_words": F.size("words").cast("long"), **{f"also{i}": c for i, c in enumerate(also)}})
    rows = _repeats(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        *(f"also{i}" for i in range(len(also))),
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = trusted(docs, labels)
    table = ratios(docs, good)
    least = threshold(good, table)
    release(good)
    got = base(docs, score(table)).withColumnRenamed("also0", "score")
    return got.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels)

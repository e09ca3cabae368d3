"""Which texts contain which others, as an equi-join on their character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: str, n: int) -> Column:
    """The distinct substrings of ``n`` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct (by, needle, text) where the text contains the needle.

    ``needles``: ``by`` columns and needle; ``texts``: ``by`` columns and text; only rows
    that agree in ``by`` meet. Texts are indexed by all their substrings of up to three
    characters. A needle that short is looked up as it is; a longer one by that of its
    trigrams that fewest texts have, and what is found is verified. So a pair is only
    looked at if it shares a rare trigram. An empty needle is in every text; null is in
    none and contains nothing.
    """
    by = by or []
    needles, texts = needles.select(*by, "needle").where("needle is not null").distinct(), texts.select(*by, "text").where("text is not null").distinct()
    all_grams = F.concat(F.array(F.lit("")), *(_grams("text", n) for n in range(1, GRAM + 1)))
    index = texts.select(*by, "text", F.explode(all_grams).alias("__gram"))
    holders = index.where(F.length("__gram") == GRAM).groupBy(*by, "__gram").agg(F.count("*").alias("__n"))
    short = needles.where(F.length("needle") <= GRAM).withColumn("__gram", F.col("needle"))
    long = needles.where(F.length("needle") > GRAM).select(*by, "needle", F.explode(_grams("needle", GRAM)).alias("__gram"))
    rare = long.join(holders, [*by, "__gram"], "left").groupBy(*by, "needle").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("__x"))
    keyed = short.unionByName(rare.select(*by, "needle", F.col("__x.__gram").alias("__gram")))
    return keyed.join(index, [*by, "__gram"]).where(F.contains("text", "needle")).select(*by, "needle", "text")

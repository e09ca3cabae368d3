"""Pages of repository listings and readmes as rows.

The pages come as a table (url, html), whoever fetched them, so that results are
reproducible; ``fetch`` is an optional helper for live use.
"""

from __future__ import annotations

import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.html import html_readme, html_repositories

# Fixed value: the form of a repository's address.
URL = r"^https://github\.com/([a-zA-Z0-9._-]+)/([a-zA-Z0-9._-]+)$"
SINCE = ("daily", "weekly", "monthly")
MOST_URLS, MOST_BYTES = 10, 5 << 20


def fetch(url: str, timeout: float = 20.0) -> tuple[int, str]:
    """(status, text); -1 for a timeout, -2 for a network error; at most 5 MB."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.status or 200, r.read(MOST_BYTES).decode("utf-8", "replace")
    except TimeoutError:
        return -1, "timeout"
    except (urllib.error.URLError, OSError, ValueError) as e:
        return -2, str(e)


def fetched(urls: DataFrame, timeout: float = 20.0) -> DataFrame:
    """(url, status, html) of each url, fetched by the tasks; html is null where the status is not 200."""

    def run(batches):
        for part in batches:
            got = [fetch(u, timeout) for u in part["url"]]
            yield pd.DataFrame({"url": part["url"], "status": [s for s, _ in got], "html": [t if s == 200 else None for s, t in got]})

    return urls.select("url").mapInPandas(run, "url string, status int, html string")


def trending(pages: DataFrame, limit: int = 0, since: str = "daily") -> DataFrame:
    """(url, rank, repository fields) of listing pages; ``limit`` 0 takes all (25 at most)."""
    if since not in SINCE:
        raise ValueError(f"since must be one of {SINCE}")
    rows = pages.select(F.col("url").alias("page"), F.posexplode(html_repositories("html")).alias("rank", "r")).select("page", "rank", "r.*")
    return rows.where(F.col("rank") < limit) if limit > 0 else rows


# The report's labels.
SINCE_LABELS = {"daily": "Daily（今日）", "weekly": "Weekly（本周）", "monthly": "Monthly（本月）"}
HEAD = "# GitHub Trending Repositories\n\n> **时间范围**: {since}\n> **编程语言**: {language}\n> **生成时间**: {made} CST\n> **数据来源**: [GitHub Trending]("
ANY_LANGUAGE, TODAY, FOOT = "不限", " (今日 +", "个上榜仓库*"


def trending_markdown(rows: DataFrame, made: str, since: str = "daily", language: str = "") -> DataFrame:
    """(page, n, markdown): the report of each listing: head, a section for each repository, their number. ``made`` is its time."""
    today = F.when(F.col("stars_today") != "", F.concat(F.lit(TODAY), "stars_today", F.lit(")"))).otherwise("")
    also = [F.when(F.col(c) != "", F.concat(F.lit(f"\n- **{c.title()}**: "), F.col(c))).otherwise("") for c in ("language", "description")]
    line = F.concat(F.lit("## "), (F.col("rank") + 1).cast("string"), F.lit(". ["), "full_name", F.lit("]("), "url", F.lit(")\n\n- **Stars**: "), "stars", today, F.lit("\n- **Forks**: "), "forks", *also)
    got = rows.groupBy("page").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n\n---\n\n").alias("body"))  # 25 rows a page at most
    head = F.concat(F.lit(HEAD.format(since=SINCE_LABELS[since], language=language or ANY_LANGUAGE, made=made)), F.col("page").cast("string"), F.lit(")\n\n---\n\n"))
    return got.select("page", "n", F.concat(head, "body", F.lit("\n\n---\n\n*共 "), F.col("n").cast("string"), F.lit(f" {FOOT}\n")).alias("markdown"))


def write_report(rows: DataFrame, folder: str, made: str, since: str = "daily", language: str = "") -> None:
    """Reports of listing pages made at a time (text), one text row a page, under since=.../day=...; a day written again is replaced."""
    if since not in SINCE:
        raise ValueError(f"since must be one of {SINCE}")
    trending_markdown(rows, made, since, language).write.mode("overwrite").json(f"{folder}/since={since}/day={made[:10]}")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).schema("page string, n long, markdown string, since string, day string").json(f"{folder}/*/*")


def success(rows: DataFrame) -> DataFrame:
    """(succeeded, total) over rows with ok."""
    return rows.agg(F.count_if("ok").alias("succeeded"), F.count("*").alias("total"))


def requested(urls: DataFrame, column: str = "urls", most: int = MOST_URLS) -> DataFrame:
    """(pos, url, valid): comma-separated lists, each url once, the first ``most`` (of them all, in the order of their places)."""
    rows = urls.select(F.posexplode(F.split(column, ",")).alias("at", "url")).select("at", F.trim("url").alias("url")).where("url != ''")
    first = rows.groupBy("url").agg(F.min("at").alias("at")).orderBy("at", "url").limit(most)  # a few rows from here on
    return first.select(F.row_number().over(Window.orderBy("at", "url")).alias("pos"), "url", F.col("url").rlike(URL).alias("valid"))


def readmes(asked: DataFrame, pages: DataFrame, most: int = 8000) -> DataFrame:
    """(pos, url, ok, text): readme texts with blank lines collapsed, cut to ``most``."""
    got = asked.where("valid").join(pages.select("url", html_readme("html").alias("text")), "url", "left")
    bad = asked.where("not valid").withColumn("text", F.lit(None).cast("string"))
    both = got.unionByName(bad)
    return both.select("pos", "url", F.coalesce(F.col("text") != "", F.lit(False)).alias("ok"), F.left("text", F.lit(most)).alias("text"))

"""Audit records: redaction, sequence numbers, a dated sink and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import ellipsis, redact

from .policy import NONE, Policy, decide, resource_of
from .running import STEP, sums_before

DAYS = 30


def records(calls: DataFrame, policies: list[Policy], risk: str = "risk_level") -> DataFrame:
    """Audit rows of tool calls (call_id, session_id, subject, tool_name, args, risk, ts, result, error)."""
    rows = calls.withColumn("resource", resource_of(F.col("tool_name"), F.col("args")))
    rows = rows.withColumn("decision", decide(policies, "subject", "tool_name", "resource"))
    low = F.coalesce(F.col(risk) == "low", F.lit(False))
    status = F.when(F.col("decision") == "deny", "denied").when((F.col("decision") == NONE) & ~low, "escalated").when(F.col("error").isNotNull(), "error").otherwise("success")
    ran = status.isin("success", "error")
    return rows.select(
        "ts",
        "call_id",
        "subject",
        "session_id",
        "tool_name",
        F.col("tool_name").alias("action"),
        "resource",
        F.col(risk).alias("risk_level"),
        redact("args").alias("parameters"),
        status.alias("status"),
        F.when(ran, ellipsis("result")).alias("result_summary"),
        F.when(ran, ellipsis("error")).alias("error_message"),
        (status == "escalated").alias("escalated"),
    )


def number(rows: DataFrame, order: list[str], day: str = "day") -> DataFrame:
    """Adds call_sequence, 1 for the first row, over the whole table.

    Rows are counted by day first, and numbered in steps within a day: no task
    sees more than a step's share, whatever the table holds.
    """
    ts = F.col(order[0])
    rows = rows.withColumn("__d", F.to_date(ts)).withColumn("__h", F.floor((F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) * STEP / 86400))
    counts = rows.groupBy("__d", "__h").count()
    ahead = sums_before(counts, "__d", "__h", "count", "__before")
    rows = rows.join(ahead.select(F.col("__d").alias("__rd"), F.col("__h").alias("__rh"), "__before"), F.col("__d").eqNullSafe(F.col("__rd")) & F.col("__h").eqNullSafe(F.col("__rh")))
    inner = Window.partitionBy("__d", "__h").orderBy(*order)
    return rows.withColumn("call_sequence", F.col("__before") + F.row_number().over(inner)).drop("__d", "__h", "__rd", "__rh", "__before")


def append(rows: DataFrame, path: str, most: int = 500_000) -> None:
    """Append rows as JSON lines under day=YYYY-MM-DD, files of at most ``most`` rows."""
    rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("day").option("maxRecordsPerFile", most).json(path)


def retained(rows: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    """Rows of the last ``days`` days, by day, so that whole partitions drop out."""
    return rows.where(F.to_date("ts") >= F.date_sub(F.lit(as_of).cast("date"), days))


def clean(spark, path: str, as_of: str, days: int = DAYS) -> int:
    """Delete day folders older than ``days``; returns how many went."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    oldest = spark.range(1).select(F.date_sub(F.lit(as_of).cast("date"), days).cast("string")).first()[0]
    gone = 0
    for f in fs.listStatus(root) if fs.exists(root) else []:
        name = f.getPath().getName()
        if name.startswith("day=") and name[4:] < oldest:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone

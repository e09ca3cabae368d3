"""Pieces that several operators share: words, batches, shared storage, folds.

Null convention of the whole subpackage: a null text acts as an empty text, a
null ``doc_id`` is carried through and sorts after every other id.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max


#: Rows of a batch that goes to Python; texts are long, and a batch stands in memory several times.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ``BATCH_ROWS``, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null id: -1)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again.

    This cuts the lineage on storage that every executor reaches, so a lost
    executor costs no recomputation. The folder goes when the driver ends, or
    with ``release`` as soon as nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weft_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``."""
    remove(df.sparkSession, df.weft_path)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffles of plans that nothing holds any more.

    Its cleaner waits for the driver's next garbage collection, which may come long
    after a large shuffle has been read for the last time.
    """
    gc.collect()
    spark._jvm.System.gc()


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone; the cluster's own cleaning takes over
        return


def slices(batches, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of ``column``."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = max(col.nbytes, 1)
        step = max(1, n * most // size) if size > most else n
        for at in range(0, n, step):
            yield batch.slice(at, step)


def blobs(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
    return col.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


class Memo(dict):
    """A bounded cache of ``make(word)``; it is emptied when full."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def even_keys(n: int) -> list[int]:
    """An int for each of ``n`` partitions that Spark's hash partitioning sends there.

    Dealing out ``range(n)`` by hash leaves some partitions empty and others with
    several keys. Spark hashes an int by Murmur3 (x86, 32 bits) with seed 42.
    """
    keys, k = {}, 0
    while len(keys) < n:
        keys.setdefault(_murmur3(k) % n, k)
        k += 1
    return [keys[i] for i in range(n)]


def _murmur3(k: int) -> int:
    """The signed hash of a 32-bit int."""
    mask = 0xFFFFFFFF
    roll = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    h = 42 ^ (roll((k * 0xCC9E2D51) & mask, 15) * 0x1B873593) & mask
    h = (roll(h, 13) * 5 + 0xE6546B64) & mask ^ 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & mask
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def cell_key(cells: int, partitions: int):
    """A function from cell numbers (an int column) to keys that spread the cells over the partitions."""
    if cells > partitions:
        return lambda cell: cell
    known = F.array(*map(F.lit, even_keys(partitions)[:cells]))
    return lambda cell: F.element_at(known, cell + 1)


def near_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

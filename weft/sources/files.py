"""Files and folders through Spark's own file systems; problems come as text, not as exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def kind(spark: SparkSession, path: str) -> str:
    """"file", "directory" or "none"."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return "none"
    return "directory" if fs.getFileStatus(p).isDirectory() else "file"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content, error): each file whole; bytes that are no UTF-8 give an error."""
    raw = spark.read.format("binaryFile").load(paths)
    text = F.try_validate_utf8("content")
    return raw.select("path", text.alias("content"), F.when(text.isNull(), F.concat(F.lit("not UTF-8: "), "path")).alias("error"))


def read_file(spark: SparkSession, path: str) -> str:
    found = kind(spark, path)
    if found != "file":
        return f"error: {'no such file' if found == 'none' else 'not a file'}: {path}"
    row = read_files(spark, path).first()
    return row["content"] if row["error"] is None else f"error: {row['error']}"


def write_file(spark: SparkSession, path: str, content: str) -> str:
    """Overwrite one file, with its folders."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return f"wrote {len(content)} characters to {path}"


def append_file(spark: SparkSession, path: str, content: str) -> str:
    """Append to one file, or create it."""
    before = read_file(spark, path) if kind(spark, path) == "file" else ""
    write_file(spark, path, before + content)
    return f"appended {len(content)} characters to {path}"


def write_rows(df: DataFrame, path: str, column: str = "text", mode: str = "overwrite") -> None:
    """A text column as lines, one file a partition."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, is_dir, size) of a folder's entries, by path."""
    fs, p = _fs(spark, path)
    found = fs.listStatus(p) if fs.exists(p) else []
    rows = [(f.getPath().toString(), f.getPath().getName(), f.isDirectory(), None if f.isDirectory() else f.getLen()) for f in found]
    return spark.createDataFrame(rows, "path string, name string, is_dir boolean, size bigint").orderBy("path")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, size) of all files below a folder, listed by Spark's file index; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    return found.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "size")


def folder_sizes(found: DataFrame) -> DataFrame:
    """(parent, name, size, n): each folder that holds files, with their bytes, and its place among its parent's by name."""
    sizes = found.groupBy("folder").agg(F.sum("size").alias("size"))
    rows = sizes.select(F.regexp_extract("folder", "^(.*)/[^/]*$", 1).alias("parent"), F.element_at(F.split("folder", "/"), -1).alias("name"), "size")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("parent").orderBy("name")))


def kinds(asked: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """Adds kind to paths: "file", "directory" (that holds files) or "none"."""
    known = found.select(F.col("path").alias("__p"), F.lit("file").alias("kind")).unionByName(found.select(F.col("folder").alias("__p"), F.lit("directory").alias("kind")).distinct())
    return asked.join(known, F.col(path) == F.col("__p"), "left").withColumn("kind", F.coalesce("kind", F.lit("none"))).drop("__p")


def listing_text(entries: DataFrame) -> DataFrame:
    label = F.when(F.col("is_dir"), F.concat(F.lit("[DIR]  "), "name")).otherwise(F.concat(F.lit("[FILE] "), "name", F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes)")))
    return entries.select("path", label.alias("line"))


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file, or a folder with all that is in it."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))

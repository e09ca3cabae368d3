"""Task graphs: edges, layers, validation, failure cascades, placeholders.

``tasks``: task_id, dependencies array<string>, and status and result where used.
Layers and cascades contract the graph in rounds that are written to the shared
folder, so plans stay flat and a lost executor loses no round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .running import step_of, sums_before
from .stored import drop, folder, forget, write

HOLE = r"\{\{(.+?)\}\}"


def edges(tasks: DataFrame) -> DataFrame:
    """(src, dst): dst depends on src; ids that are no tasks stay."""
    return tasks.select(F.explode("dependencies").alias("src"), F.col("task_id").alias("dst"))


def missing(tasks: DataFrame) -> DataFrame:
    """(task_id, dep) where the dependency is no task."""
    e = edges(tasks).select(F.col("dst").alias("task_id"), F.col("src").alias("dep")).distinct()
    return e.join(tasks.select(F.col("task_id").alias("dep")), "dep", "left_anti").select("task_id", "dep")


def inner_edges(tasks: DataFrame) -> DataFrame:
    """Distinct (src, dst) between tasks of the batch."""
    ids = tasks.select(F.col("task_id").alias("src"))
    return edges(tasks).where("dst is not null").join(ids, "src", "left_semi").select("src", "dst").distinct()


def settle(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Solve value(v) = max(own(v), value(u) + w for every link u -> v) for all nodes that are
    in or behind no cycle: (task_id, value) of those, and (task_id, value) so far of the others.

    ``nodes``: task_id, value long; ``links``: src, dst, w long, both ends being nodes.

    A node's table row says how many open links it has, and where the only one comes from. In
    a round every link meets its source once and tells its node the value along it. A link from
    a settled node is done with; one from a node that itself has one open link only is moved to
    where that one comes from, with the sum of both weights. Nodes left without links
    are settled. So ways through nodes with one link halve every round, and a chain of n
    nodes takes about log2(n) rounds; links never become more. Every round replaces the
    tables of open nodes and links and adds what it settles to one folder.
    Joins of rounds are merge joins: a broadcast would send tables to the driver each round.
    """
    spark = nodes.sparkSession
    name = nodes.schema["task_id"]
    row = StructType([name, StructField("value", LongType()), StructField("n", LongType()), StructField("via", name.dataType), StructField("more", LongType()), StructField("open", BooleanType())])
    path, n = folder(spark, "settled"), 0

    def noted(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The round's nodes after what its links tell, written: settled and open ones in folders of their own."""
        live = F.when(F.col("src").isNotNull(), F.struct("src", "w"))
        found = links.groupBy(F.col("dst").alias("task_id")).agg(F.max("told").alias("told"), F.count("src").alias("n"), F.max(live).alias("x"))
        rows = rows.select("task_id", "value").join(found.hint("merge"), "task_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rows = rows.select("task_id", F.greatest("value", "told").alias("value"), "n", F.col("x.src").alias("via"), F.col("x.w").alias("more"), (F.col("n") > 0).alias("open"))
        rows.write.partitionBy("open").parquet(f"{path}/round={n}")
        return spark.read.schema(row).parquet(f"{path}/round={n}")

    links = write(links.withColumn("told", F.lit(None).cast("long")), "links")
    now = noted(nodes, links)
    most = now.count()  # no way is longer; cycles would go on adding
    while not now.where("not open").isEmpty() and not now.where("open").isEmpty():
        ends = spark.read.schema(row).parquet(path).withColumnRenamed("task_id", "src")  # the settled of all rounds, the open of the last
        met = links.select("src", "dst", "w").join(ends.hint("merge"), "src")
        single = F.col("n") == 1
        far = F.when(single, F.least(F.col("w") + F.col("more"), F.lit(most))).otherwise(F.col("w"))
        start = F.when(single, F.col("via")).when(F.col("open"), F.col("src"))  # null: the source is settled
        moved = met.groupBy(start.alias("src"), "dst").agg(F.max(far).alias("w"), F.max(F.col("value") + F.col("w")).alias("told"))
        before, links = links, write(moved, "links")
        forget(before)
        n += 1
        now = noted(now.where("open"), links)
        drop(spark, f"{path}/round={n - 1}/open=true")
    forget(links)
    return spark.read.schema(row).parquet(path).where("not open").select("task_id", "value"), now.where("open").select("task_id", "value")


def layers(tasks: DataFrame) -> DataFrame:
    """(task_id, layer): 0 for tasks without a dependency inside the batch, else one more
    than the deepest of them. Tasks in or behind a cycle have no row."""
    nodes = tasks.select("task_id").distinct().withColumn("value", F.lit(0).cast("long"))
    done, _ = settle(nodes, inner_edges(tasks).withColumn("w", F.lit(1).cast("long")))
    return done.select("task_id", F.col("value").cast("int").alias("layer"))


def validate(tasks: DataFrame) -> DataFrame:
    """(task_id, problem): missing dependencies, and tasks in or behind a cycle."""
    lost = missing(tasks).select("task_id", F.concat(F.lit("missing:"), "dep").alias("problem"))
    stuck = tasks.select("task_id").distinct().join(layers(tasks), "task_id", "left_anti")
    return lost.unionByName(stuck.select("task_id", F.lit("cycle").alias("problem")))


def cascade(tasks: DataFrame) -> DataFrame:
    """The tasks with failures passed on: whoever depends on a failed task, however far, fails
    with an empty result. Tasks in or behind a cycle, which ``settle`` leaves, pass theirs on
    step by step; rounds append what fails anew to one folder."""
    spark = tasks.sparkSession
    links = inner_edges(tasks)
    own = tasks.groupBy("task_id").agg(F.max(F.coalesce(F.col("status") == "failed", F.lit(False)).cast("long")).alias("value"))
    done, stuck = settle(own, links.withColumn("w", F.lit(0).cast("long")))
    shape = StructType([tasks.schema["task_id"]])
    path, n = folder(spark, "failed"), 0
    stuck.where("value = 1").select("task_id").write.parquet(f"{path}/round=0")
    if not stuck.isEmpty():
        known = write(links.join(stuck.select(F.col("task_id").alias("dst")), "dst", "left_semi").select("src", "dst"), "edges")
        while not (front := spark.read.schema(shape).parquet(f"{path}/round={n}")).isEmpty():
            failed = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(path)
            nxt = known.join(front.select(F.col("task_id").alias("src")), "src").select(F.col("dst").alias("task_id")).distinct()
            n += 1
            nxt.join(failed, "task_id", "left_anti").write.parquet(f"{path}/round={n}")
        forget(known)
    late = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(path)
    bad = done.where("value = 1").select("task_id").unionByName(late).withColumn("__late", F.lit(True))
    rows = tasks.join(bad, "task_id", "left").withColumn("__late", F.col("__late") & ~F.coalesce(F.col("status") == "failed", F.lit(False)))
    return rows.withColumns({"status": F.when(F.col("__late"), "failed").otherwise(F.col("status")), "result": F.when(F.col("__late"), "").otherwise(F.col("result"))}).drop("__late")


def dependency_inputs(tasks: DataFrame) -> DataFrame:
    """(task_id, dep_pos, dep, state, preview) for each dependency: missing, its status, or its result."""
    d = tasks.select("task_id", F.posexplode("dependencies").alias("dep_pos", "dep"))
    known = tasks.select(F.col("task_id").alias("dep"), F.lit(True).alias("__known"), F.col("status").alias("__status"), F.col("result").alias("__result"))
    rows = d.join(known, "dep", "left")
    done = F.col("__status") == "completed"
    state = F.when(F.col("__known").isNull(), "missing").when(done, "completed").otherwise(F.coalesce("__status", F.lit("")))
    preview = F.when(done, F.coalesce(F.nullif(F.left("__result", F.lit(2000)), F.lit("")), F.lit("(无结果)")))
    return rows.select("task_id", "dep_pos", "dep", state.alias("state"), preview.alias("preview"))


def blocked(tasks: DataFrame) -> DataFrame:
    """Tasks with a failed dependency."""
    bad = tasks.where("status = 'failed'").select(F.col("task_id").alias("src"))
    hit = edges(tasks).join(bad, "src", "left_semi").select(F.col("dst").alias("task_id"))
    return tasks.join(hit, "task_id", "left_semi")


def ready(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks whose dependencies have all completed."""
    done = tasks.where("status = 'completed'").select(F.col("task_id").alias("src"))
    waits = edges(tasks).join(done, "src", "left_anti").select(F.col("dst").alias("task_id"))
    return tasks.where("status = 'pending'").join(waits, "task_id", "left_anti")


def _pieces(column: str | Column) -> Column:
    """A text cut at its placeholders; those begin with \\u0002."""
    return F.split(F.regexp_replace(column, HOLE, "\u0001\u0002$1\u0001"), "\u0001")


def _named(piece: Column) -> Column:
    return F.regexp_replace(F.trim(F.substring(piece, 2, 2**31 - 1)), r"\.result$", "")


def holes(column: str | Column) -> Column:
    """The distinct ids that a text's placeholders name."""
    return F.array_distinct(F.transform(F.filter(_pieces(column), lambda p: p.startswith("\u0002")), _named))


def filled(column: str | Column, said: str) -> Column:
    """A text with its placeholders replaced by what ``said``, an array of (ref, result), has for them."""

    def text(piece: Column) -> Column:
        name, kept = _named(piece), F.concat(F.lit("{{"), F.substring(piece, 2, 2**31 - 1), F.lit("}}"))
        known = F.get(F.filter(said, lambda x: x["ref"] == name), F.lit(0))["result"]
        return F.when(piece.startswith("\u0002"), F.coalesce(known, kept)).otherwise(piece)

    return F.array_join(F.transform(_pieces(column), text), "")


def resolve(texts: DataFrame, results: DataFrame, key: str = "task_id", column: str = "description") -> DataFrame:
    """Replace ``{{id}}`` and ``{{id.result}}`` by results, in one pass; unknown ones stay.

    ``results``: task_id, result. The distinct ids that a text names are looked up by a
    join, and what is found goes back to it, so what a result contains is not resolved
    again; the rest of the text is not moved for it. Adds resolved.
    """
    asked = texts.select(key, F.explode(holes(column)).alias("ref"))
    found = asked.join(results.select(F.col("task_id").alias("ref"), "result"), "ref")
    said = found.groupBy(key).agg(F.collect_list(F.struct("ref", "result")).alias("__said"))
    return texts.join(said, key, "left").withColumn("resolved", filled(column, "__said")).drop("__said")


def all_terminal(status: Column) -> Column:
    return F.bool_and(F.coalesce(status.isin("completed", "failed"), F.lit(False)))


def any_pending(status: Column) -> Column:
    return F.bool_or(F.coalesce(status.isin("pending", "running"), F.lit(False)))


def run_layers(tasks: DataFrame, execute) -> DataFrame:
    """Run the graph layer by layer.

    ``execute(DataFrame of ready tasks) -> DataFrame(task_id, result, error)`` is
    injected. Failures cascade, placeholders resolve from the results so far, and
    tasks that no layer reaches, or that ``execute`` says nothing of, fail. Tasks, and
    what each needs of which earlier layer, are written once, by layer; a layer reads its
    own and the outcomes of the layers that it names, and writes its outcomes.
    """
    spark = tasks.sparkSession
    placed = write(layers(tasks), "layers")
    by_layer, needs, path = folder(spark, "by-layer"), folder(spark, "needs"), folder(spark, "outcomes")
    name, none = tasks.schema["task_id"], F.array().cast("array<string>")
    tasks.join(placed, "task_id").write.partitionBy("layer").parquet(by_layer)
    order = spark.read.schema(StructType([*tasks.schema.fields, StructField("layer", IntegerType())])).parquet(by_layer)
    asks = order.select("task_id", "layer", F.coalesce("dependencies", none).alias("deps"), F.coalesce(holes("description"), none).alias("holes"))
    asks = asks.withColumn("ref", F.explode(F.array_union("deps", "holes")))
    earlier = placed.select(F.col("task_id").alias("ref"), F.col("layer").alias("of"))
    in_ = lambda c: F.exists(c, lambda x: x.eqNullSafe(F.col("ref"))).alias(c)
    asks.select("task_id", "layer", "ref", in_("deps"), in_("holes")).join(earlier, "ref").where("of < layer").write.partitionBy("layer").parquet(needs)
    need = spark.read.schema(StructType([name, StructField("ref", name.dataType), StructField("deps", BooleanType()), StructField("holes", BooleanType()), StructField("of", IntegerType()), StructField("layer", IntegerType())])).parquet(needs)
    last = placed.agg(F.max("layer")).first()[0]
    named = dict(need.groupBy("layer").agg(F.collect_set("of")).collect())  # numbers of layers
    shape = StructType([name, StructField("__status", StringType()), StructField("__result", StringType())])
    for layer in range(0 if last is None else last + 1):
        now = spark.read.schema(tasks.schema).parquet(f"{by_layer}/layer={layer}").withColumns({"status": F.lit("pending"), "result": F.lit(None).cast("string")})
        lost = None
        if layer in named:
            done = spark.read.schema(shape).parquet(*(f"{path}/layer={n}" for n in sorted(named[layer]))).withColumnRenamed("task_id", "ref")
            own = need.where(F.col("layer") == layer)
            # all dependencies are settled by now, so a failure only has to pass on one step
            lost = own.where("deps").join(done.where("__status = 'failed'"), "ref", "left_semi").select("task_id").distinct()
            said = own.where("holes").select("task_id", "ref").join(done.where("__status = 'completed'"), "ref")
            said = said.groupBy("task_id").agg(F.collect_list(F.struct("ref", F.col("__result").alias("result"))).alias("__said"))
            now = now.join(lost, "task_id", "left_anti").join(said, "task_id", "left").withColumn("description", filled("description", "__said")).drop("__said")
        got = execute(now).select("task_id", F.when(F.col("error").isNotNull(), "failed").otherwise("completed").alias("__status"), F.coalesce("result", F.lit("")).alias("__result"))
        if lost is not None:
            got = got.unionByName(lost.select("task_id", F.lit("failed").alias("__status"), F.lit("").alias("__result")))
        got.write.parquet(f"{path}/layer={layer}")
    drop(spark, by_layer)
    drop(spark, needs)
    forget(placed)
    done = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(path) if last is not None else spark.createDataFrame([], shape)
    rows = tasks.drop("status", "result").join(done, "task_id", "left")
    return rows.withColumns({"status": F.coalesce("__status", F.lit("failed")), "result": F.coalesce("__result", F.lit(""))}).select(*dict.fromkeys([*tasks.columns, "status", "result"]))


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values, numbered in the order in which they first occur.

    ``order`` is a number. Values are counted by step of it, and numbered within a
    step after those before, so no task sees them all.
    """
    got = rows.groupBy(column).agg(F.min(order).alias("first")).withColumn("__b", step_of("first"))
    totals = got.groupBy("__b", step_of("__b").alias("__t")).agg(F.count("*").alias("__c"))
    ahead = sums_before(totals, "__t", "__b", "__c", "__n").select(F.col("__b").alias("__s"), "__n")
    got = got.join(ahead, F.col("__b").eqNullSafe(F.col("__s")))
    rank = F.col("__n") + F.row_number().over(Window.partitionBy("__b").orderBy("first", column))
    return got.select(column, "first", rank.cast("int").alias("rank"))

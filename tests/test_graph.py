import os
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.operators import graph

DDL = "task_id string, dependencies array<string>, status string, result string, description string"


def frame(spark, deps, status=None):
    return spark.createDataFrame([(t, d, (status or {}).get(t, "pending"), None, f"do {t}") for t, d in deps.items()], DDL)


def loop_layers(deps):
    inner = {t: {d for d in ds if d in deps} for t, ds in deps.items()}
    out, layer = {}, 0
    while now := [t for t in inner if t not in out and inner[t] <= {x for x in out if out[x] < layer}]:
        for t in now:
            out[t] = layer
        layer += 1
    return out


@pytest.mark.parametrize(
    ("deps", "want"),
    [
        ({"t1": [], "t2": [], "t3": ["t1", "t2"]}, {"t1": 0, "t2": 0, "t3": 1}),
        ({"t3": ["t1"], "t4": ["t2"]}, {"t3": 0, "t4": 0}),
        ({"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "x"]}, {"a": 0, "b": 1, "c": 2, "d": 3}),
        ({"r": [], "a": ["r", "b"], "b": ["a"]}, {"r": 0}),
        ({}, {}),
    ],
)
def test_golden_layers(spark, deps, want):
    assert {r.task_id: r.layer for r in graph.layers(frame(spark, deps)).collect()} == want


def test_layers_equal_a_loop(spark):
    rnd = random.Random(9)
    deps = {str(i): [str(rnd.randint(0, 70)) for _ in range(rnd.randint(0, 2))] for i in range(60)}
    assert {r.task_id: r.layer for r in graph.layers(frame(spark, deps)).collect()} == loop_layers(deps)


def test_validation(spark):
    got = {(r.task_id, r.problem) for r in graph.validate(frame(spark, {"a": ["b"], "b": ["a"], "c": ["x"]})).collect()}
    assert got == {("a", "cycle"), ("b", "cycle"), ("c", "missing:x")}


def test_cascade(spark):
    got = graph.cascade(frame(spark, {"a": [], "b": ["a"], "c": ["b"], "d": []}, {"a": "failed"}))
    assert {r.task_id: r.status for r in got.collect()} == {"a": "failed", "b": "failed", "c": "failed", "d": "pending"}


def test_placeholders_are_resolved_once(spark):
    texts = spark.createDataFrame([("q", "x {{t1}} {{t1.result}} {{t9}} {{ t2 }}"), ("n", None)], "task_id string, description string")
    results = spark.createDataFrame([("t1", "A{{t2}}"), ("t2", "$1\\")], "task_id string, result string")
    got = {r.task_id: r.resolved for r in graph.resolve(texts, results).collect()}
    assert got == {"q": "x A{{t2}} A{{t2}} {{t9}} $1\\", "n": None}


def test_layer_runs(spark):
    deps = {"a": [], "b": ["a"], "c": ["b"], "x": ["y"], "y": ["x"]}
    df = frame(spark, deps).withColumn("description", F.when(F.col("task_id") == "b", "see {{a}}").otherwise(F.col("description")))
    run = lambda d: d.select("task_id", F.concat(F.lit("ok:"), "description").alias("result"), F.when(F.col("task_id") == "zz", "e").alias("error"))
    got = {r.task_id: (r.status, r.result) for r in graph.run_layers(df, run).collect()}
    assert got["b"] == ("completed", "ok:see ok:do a") and got["x"] == ("failed", "") and got["c"][0] == "completed"


def rounds(monkeypatch, tmp_path, work):
    """How many rounds of ``settle`` a job takes."""
    paths = []
    monkeypatch.setattr(graph, "folder", lambda spark, label, plain=graph.folder: paths.append((label, plain(spark, label))) or paths[-1][1])
    got = work()
    (path,) = [p for label, p in paths if label == "settled"]
    return got, len(os.listdir(path.removeprefix("file://")))


def test_a_chain_takes_few_rounds(spark, monkeypatch, tmp_path):
    n = 10_000
    chain = spark.range(n).select(F.col("id").cast("string").alias("task_id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("dependencies"))
    got, used = rounds(monkeypatch, tmp_path, lambda: graph.layers(chain).where("cast(layer as string) = task_id").count())
    assert got == n and used < 20


def test_a_failure_passes_down_a_chain_in_few_rounds(spark, monkeypatch, tmp_path):
    n = 3000
    chain = spark.range(n).select(F.col("id").cast("string").alias("task_id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("dependencies"), F.when(F.col("id") == 10, "failed").otherwise("pending").alias("status"), F.lit("r").alias("result"))
    got, used = rounds(monkeypatch, tmp_path, lambda: graph.cascade(chain).where("status = 'failed'").count())
    assert got == n - 10 and used < 20


def test_random_graphs_with_cycles(spark):
    """Layers, failures and runs against plain loops, with cycles, self-loops, repeated and missing dependencies."""
    for seed in range(3):
        rnd = random.Random(seed)
        deps = {str(i): [str(rnd.randint(0, 45)) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))] for i in range(40)}
        status = {t: rnd.choice(["failed", "pending", "completed", "completed", "completed"]) for t in deps}
        df = frame(spark, deps, status)
        want = loop_layers(deps)
        assert {r.task_id: r.layer for r in graph.layers(df).collect()} == want
        bad = {t for t in deps if status[t] == "failed"}
        while more := {t for t in deps if t not in bad and bad & set(deps[t])}:
            bad |= more
        assert {r.task_id for r in graph.cascade(df).where("status = 'failed'").collect()} == bad
        run = lambda d: d.where("task_id != '7'").select("task_id", F.lit("ok").alias("result"), F.when(F.col("task_id") == "3", "e").alias("error"))
        outcome = {}
        for layer in range(max(want.values(), default=-1) + 1):
            for t in [t for t in want if want[t] == layer]:
                lost = any(outcome.get(d) == "failed" for d in deps[t])
                outcome[t] = "failed" if lost or t == "3" else "unknown" if t == "7" else "completed"
        got = {r.task_id: r.status for r in graph.run_layers(df, run).collect()}
        assert got == {t: "completed" if outcome.get(t) == "completed" else "failed" for t in deps}


def test_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    """No table of a round is made by a broadcast join; only the given links may be."""
    plans = []
    monkeypatch.setattr(graph, "write", lambda df, label="table", plain=graph.write: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or plain(df, label))
    deps = {str(i): [str(i // 2)] if i else [] for i in range(40)}
    assert {r.task_id: r.layer for r in graph.layers(frame(spark, deps)).collect()} == loop_layers(deps)
    later = [plan for label, plan in plans if label == "links"][1:]
    assert later and not any("BroadcastHashJoin" in plan for plan in later)


def test_a_layer_reads_only_the_outcomes_that_it_names(spark):
    """Of earlier layers, only those that a layer's dependencies and placeholders name; unknown and own ids name none."""
    deps = {"a": [], "b": ["a"], "c": ["b"], "d": ["c"], "e": ["d", "zz"]}
    says = {"a": "see {{a}} {{zz}}", "b": "no", "c": "see {{ a.result }}{{b}}", "d": "{{zz}}", "e": "{{d}} {{d.result}}"}
    df = spark.createDataFrame([(t, d, None, None, says[t]) for t, d in deps.items()], DDL)
    read = []

    def run(d):
        read.append({int(n) for path in d.inputFiles() for n in re.findall(r"weft-outcomes-[^/]*/layer=(-?\d+)", path)})
        return d.select("task_id", F.concat("task_id", F.lit(":"), "description").alias("result"), F.lit(None).cast("string").alias("error"))

    got = {r.task_id: r.result for r in graph.run_layers(df, run).collect()}
    assert got == {"a": "a:see {{a}} {{zz}}", "b": "b:no", "c": "c:see a:see {{a}} {{zz}}b:no", "d": "d:{{zz}}", "e": "e:d:{{zz}} d:{{zz}}"}
    assert read == [set(), {0}, {0, 1}, {2}, {3}]

"""Operator 12: the prefix trie of conversations, by prefix-doubling names.

Every turn has a name, a dense number for its role and text. Two neighbouring blocks
of 2^j turns, which start at a multiple of 2^(j+1), are named together by the pair of
their names, so after as many join rounds as the longest conversation has binary digits
every aligned block of a power of two has a name; equal names mean equal turns. A prefix
of d turns is put together from the blocks of d's binary digits: the list of their names
is the prefix's name, and rows with equal (d, name) are the members of one node.

A node is known by its smallest member and its depth. Sums over a subtree need no walk
down the tree: a node's own share is laid on the path of its smallest member, summed
from the path's end, and the sums of all members' paths add up to the node's.

Only numbers and 32-byte digests travel; a turn's role and text are compared by the
SHA-256 of both. Long conversations are cut: the order of their turns comes from a
range sort of the whole table with offsets for each part, sums along a path from totals
of blocks of ``STEP`` turns. The hash over a node's members is sequential by definition:
blocks of ``STEP`` ids are put in order and joined in parallel, and one task streams the
blocks of a node through the hash, a block at a time.

Rebuilding: conversation c starts with the first h turns of conversation c - c % ``SIBLINGS``
(the remainder has the sign of c, as in SQL), h = crc32(c as text) % ``HEADS``, and goes
on with its own turns after its first h.

Defined edge cases: null roles and texts are empty; a null turn comes first, turns that
tie follow their digests, so the result does not depend on the input's order; repeated
rows are turns of their own; rows without a conv_id belong to no conversation and are
left out; a conversation that keeps no turn is a member of the root only; very long texts
are one digest each; an empty table has no conversation, so not even a root; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, near_partitions, release

SIBLINGS, HEADS, STEP = 20, 4, 4096
#: Blocks of more than 2^CUT turns are dealt out again before their prefixes are written down.
CUT = 12
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digests(conversations: DataFrame) -> DataFrame:
    """c, turn, mark (the digest of role and text) and w (words of the text)."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), mark.alias("mark"), words.alias("w"))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, pos from 1, mark, w) and conversations (c, n turns)."""
    spark = turns.sparkSession
    kept = materialize(turns.withColumn("line", F.monotonically_increasing_id()), "turns")
    order = ["c", F.col("turn").asc_nulls_first(), "mark", "line"]
    sorted_ = kept.repartitionByRange(near_partitions(spark), *order).sortWithinPartitions(*order)
    sorted_ = materialize(sorted_.select("c", "mark", "w", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "placed")
    parts = sorted_.groupBy("c", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    release(kept)
    at = sorted_.join(parts.drop("rows"), ["c", "part"]).select("c", (F.col("at") - F.col("first") + F.col("ahead") + 1).alias("pos"), "mark", "w")
    return at, sorted_.groupBy("c").agg(F.count("*").alias("n"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, n, d from 1, mark, w), n turns in all, and rebuilt conversations (c, n)."""
    at, convs = placed(turns)
    of = F.col("c") - F.col("c") % SIBLINGS
    convs = convs.withColumns({"base": of, "h": F.crc32(F.col("c").cast("string")) % HEADS})
    head = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(head, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "convs")
    own = at.join(convs, "c").where("pos > h").select("c", "n", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "mark", "w")
    heads = at.where(F.col("pos") < HEADS).withColumnRenamed("c", "base")
    lent = convs.where("taken > 0").join(heads, "base").where("pos <= taken").select("c", "n", F.col("pos").alias("d"), "mark", "w")
    return own.unionByName(lent), convs.select("c", "n")


def named(keys: DataFrame, label: str) -> DataFrame:
    """Distinct rows of ``keys`` with name, dense numbers from 0: a row's place in its part, after the parts before it."""
    spark = keys.sparkSession
    found = materialize(keys.distinct().withColumn("raw", F.monotonically_increasing_id()), label)
    part = F.shiftright("raw", 33)
    sizes = sorted(found.groupBy(part.alias("part")).count().collect())  # a row for each partition
    ahead, starts = 0, []
    for p, n in sizes:
        starts.append((p, ahead))
        ahead += n
    starts = F.broadcast(spark.createDataFrame(starts, "part long, ahead long"))
    local = F.col("raw") - F.shiftleft(part, 33)
    return found.withColumn("part", part).join(starts, "part").select(*keys.columns, (F.col("ahead") + local).alias("name"))


def blocks(turns: DataFrame) -> list[DataFrame]:
    """For j = 0, 1, ...: the aligned blocks (c, n, i, name) of 2^j turns."""
    now = turns.join(named(turns.select("mark"), "names"), "mark").select("c", "n", (F.col("d") - 1).alias("i"), "name", "w")
    out = [materialize(now, "blocks")]
    while True:
        half = F.col("i") % 2
        pairs = out[-1].groupBy("c", F.shiftright("i", 1).alias("i")).agg(F.max("n").alias("n"), F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b"))
        pairs = materialize(pairs.where("a is not null and b is not null"), "pairs")
        if pairs.isEmpty():
            return out
        out.append(materialize(pairs.join(named(pairs.select("a", "b"), "names"), ["a", "b"]).select("c", "n", "i", "name"), "blocks"))
        release(pairs)


def prefixes(turns: DataFrame) -> DataFrame:
    """c, n, d, key and w: the name of every prefix, a list of block names, and the words of its last turn."""
    levels = blocks(turns)
    parts = levels[0].select("c", "n", (F.col("i") + 1).alias("d"), F.lit(-1).alias("j"), F.col("w").alias("name"))
    for j, level in enumerate(levels):
        # an even block is the binary digit j of the prefixes that end in the block after it, or with itself
        low, high = (F.col("i") + 1) * 2**j, F.least((F.col("i") + 2) * 2**j - 1, F.col("n"))
        some = level.where("i % 2 = 0").select("c", "n", "name", low.alias("low"), high.alias("high"))
        if j > CUT:
            some = some.select("c", "n", "name", F.explode(F.sequence("low", "high", F.lit(2**CUT))).alias("low"), "high")
            some = some.withColumn("high", F.least(F.col("low") + 2**CUT - 1, "high")).repartition("c", "low")
        parts = parts.unionByName(some.select("c", "n", F.explode(F.sequence("low", "high")).alias("d"), F.lit(j).alias("j"), "name"))
    got = parts.groupBy("c", "d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "name"))).alias("all"))
    return got.select("c", "n", "d", F.slice("all", 2, 64).getField("name").alias("key"), F.col("all")[0]["name"].alias("w"))


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """c, n, d, node (the smallest member of the prefix's node), n_convs and w, for every prefix and the root."""
    each = materialize(prefixes(turns), "prefixes")
    nodes = each.groupBy("d", "key").agg(F.min("c").alias("node"), F.count("*").alias("n_convs"), F.max("w").alias("w"))
    found = each.select("c", "n", "d", "key").join(nodes, ["d", "key"]).select("c", "n", "d", "node", "n_convs", "w")
    root = convs.agg(F.min("c"), F.count("*")).first()  # one row
    top = convs.select("c", "n", F.lit(0).cast("long").alias("d"), F.lit(root[0]).cast("long").alias("node"), F.lit(root[1]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("w"))
    out = materialize(found.unionByName(top), "paths")
    release(each)
    return out


def _hashed(batches):
    """SHA-256 over the id blocks of each node; the rows come in order."""
    now, state = None, None
    for batch in batches:
        done = []
        for node, d, ids in zip(*(batch.column(x).to_pylist() for x in ("node", "d", "ids")), strict=True):
            if now != (node, d):
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (node, d), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(done)
    if now:
        yield _digests([(*now, state.hexdigest())])


def _digests(done):
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["node", "d", "ends_sha256"])


def ends(path: DataFrame) -> DataFrame:
    """node, d and ends_sha256 for the nodes at which conversations end."""
    block = F.floor(F.col("c") / STEP)
    ids = path.where("d = n").groupBy("node", "d", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    return ids.repartition("node", "d").sortWithinPartitions("node", "d", "block").drop("block").mapInArrow(_hashed, "node long, d long, ends_sha256 string")


def sums(path: DataFrame, own: DataFrame) -> DataFrame:
    """node, d, n_leaves and saved_tokens: shares (c, d, saved, leaf) summed over the subtrees."""
    each = path.select("c", "d", "node").join(own.select("c", "d", "saved", "leaf"), ["c", "d"], "left").withColumn("b", F.floor(F.col("d") / STEP))
    each = each.fillna(0, ["saved", "leaf"])
    total = each.groupBy("c", "b").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    later = Window.partitionBy("c").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = total.select("c", "b", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"))
    rest = Window.partitionBy("c", "b").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    each = each.join(after, ["c", "b"]).select("node", "d", (F.col("l") + F.sum("leaf").over(rest)).alias("l"), (F.col("s") + F.sum("saved").over(rest)).alias("s"))
    return each.groupBy("node", "d").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the conversations (c, n) with their turns (c, n, d, mark, w)."""
    if convs.isEmpty():
        return convs.select(*(F.lit(None).cast("string" if x == "ends_sha256" else "long").alias(x) for x in NODE))
    path = paths(turns, convs)
    top = path.where("c = node")
    above = path.select("c", (F.col("d") + 1).alias("d"), F.col("node").alias("parent_conv_id"))
    own = materialize(top.join(above, ["c", "d"], "left").select("c", "d", "n_convs", "w", "parent_conv_id"), "nodes")
    children = own.where("d > 0").groupBy(F.col("parent_conv_id").alias("c"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    own = own.join(children, ["c", "d"], "left").withColumns({"leaf": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("w")})
    own = materialize(own, "nodes")
    done = own.join(sums(path, own).withColumnRenamed("node", "c"), ["c", "d"]).join(ends(path).withColumnRenamed("node", "c"), ["c", "d"], "left")
    return done.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12(conversations: DataFrame) -> DataFrame:
    turns, convs = rebuilt(digests(conversations))
    return trie(turns, convs)


SQL = """
WITH RECURSIVE bits(b, t, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384) ELSE t // 2 END, k + 1 FROM bits WHERE k < 8
), crc(c, digits, v) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT c, digits[2:], xor(v // 256, t) FROM crc JOIN bits ON k = 8 AND b = xor(v % 256, ascii(digits)) WHERE digits <> ''
), heads AS (
  SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE digits = ''
), own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS (
  SELECT o.c, list_concat(coalesce(b.s[1:h], []), o.s[h + 1:]) AS s FROM own o JOIN heads USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 20
), occ AS (
  SELECT c, d, s[1:d] AS p, len(s) AS n, coalesce(len(regexp_extract_all(s[d].t, '[^\\x20\\x09-\\x0D]+')), 0) AS w
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM built)
), node AS (
  SELECT d, p, min(c) AS c, count(*) AS n, max(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS e FROM occ GROUP BY d, p
), kids AS (
  SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL
), marked AS (
  SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (d, p)
), below AS (
  SELECT u AS d, p[1:u] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * CASE WHEN d = 0 THEN 0 ELSE w END) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM marked) GROUP BY ALL
)
SELECT m.c AS conv_id, m.d AS depth, up.c AS parent_conv_id, m.n AS n_convs, m.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(m.e) AS ends_sha256
FROM marked m JOIN below USING (d, p) LEFT JOIN node up ON up.d = m.d - 1 AND up.p = m.p[1:m.d - 1]
"""

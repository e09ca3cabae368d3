"""Operator 13: ranked lexical search by Fagin's threshold algorithm.

A document's score for an item is a sum over the item's terms, each worth its impact in
the document: weight w = floor(1000 ln((2N + 2) / (2 df + 1))) times
(10^9 tf) div (1000 tf + 8 m), m = 100 - 75 + (75 n N) div L, with N documents that have
terms, L terms in all, n terms of the document. All but w is whole numbers.

The forward index holds each document's terms that any item asks for, with their counts;
it is written once, and counts over all documents (N, L, df) come from that. Documents
are dealt into shards and items into blocks, both of bounded size. A cell is a shard with a block: it
sorts the shard's postings of the block's terms by impact and runs the threshold
algorithm for each item. The lists of the item's terms are read round-robin, ``STEP``
postings each and twice as many the next time; every document met is scored in full by
look-ups in the forward index. What is not yet met scores at most the sum of the impacts
read last; the item is done when that threshold falls strictly below its k-th score (so
that ties are all seen) or all lists are read. The k best of every shard meet in one window.

Nothing is broadcast but a bitmap of fixed size (``BITS``) over the items' terms. It only
thins out the index; terms that pass by chance match no item's term.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased.

Defined edge cases: null texts and texts without terms hold no term and are no documents for
N and L; items without a term that any document has give no rows; a term that an item
repeats counts as often; rows that repeat an id are ranked as documents of their own,
rows that repeat an item are items of their own; a document without an id ranks after
equal scores with one, an item without one gives rows with a null item_id; documents
that tie follow their ids; scores of 0 give no row; a very long text is one set of counted terms;
empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, Memo, blobs, cell_key, ids, materialize, near_partitions, slices

K, STEP = 10, 32
#: Bits of the bitmap; most documents and postings of a shard, fewest documents of one, and terms of a block of items.
BITS, DOCS, POSTINGS, FEW, TERMS = 1 << 22, 16_384, 4_000_000, 256, 200_000
#: Bytes that separate terms become spaces, A-Z becomes a-z.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_INDEX = "n long, terms array<binary>, tfs array<long>"


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def counted(texts: DataFrame, key: str, bits: np.ndarray | None = None) -> DataFrame:
    """``key``, n, terms and tfs of every text that has a term; with ``bits`` only terms whose bit is set."""

    def run(batches):
        known = Memo(lambda t: bits is None or bool(bits[(h := zlib.crc32(t) % BITS) >> 3] >> (h & 7) & 1))
        for batch in slices(batches):
            at, n, found, tfs = [], [], [], []
            for i, raw in enumerate(blobs(batch)):
                if words := terms(raw):
                    counts = {t: c for t, c in Counter(words).items() if known[t]}
                    at.append(i)
                    n.append(len(words))
                    found.append(list(counts))
                    tfs.append(list(counts.values()))
            taken = batch.column(batch.schema.get_field_index(key)).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64()))], [key, "n", "terms", "tfs"])

    return texts.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, {_INDEX}")


def bitmap(vocabulary: DataFrame) -> np.ndarray:
    """``BITS`` bits as bytes, of which those of the terms' hashes are set."""
    at = F.crc32("term") % BITS + 1
    rows = vocabulary.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for part, bits in rows.collect():  # at most BITS / 32768 rows
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out


def weighted(items: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """item, item_id, terms and coefs (weight times repeats) of the items' terms that documents have."""
    each = items.select("item", "item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", "item_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("repeats"))
    holders = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    pairs = each.join(holders, "term").select("item", "item_id", F.struct("term", (weight * F.col("repeats")).cast("long").alias("coef")).alias("p"))
    got = pairs.groupBy("item").agg(F.first("item_id").alias("item_id"), F.sort_array(F.collect_list("p")).alias("p"))
    return got.select("item", "item_id", F.col("p.term").alias("terms"), F.col("p.coef").alias("coefs"))


class Shard:
    """Documents with their forward index and, for each term, its postings by falling impact."""

    def __init__(self, table: pa.Table, vocabulary: dict[bytes, int], n_docs: int, n_terms: int):
        self.ids = ids(table, "doc_id")
        col = table.column("terms").combine_chunks()
        words = col.flatten().dictionary_encode()
        known = np.array([vocabulary.get(t, -1) for t in words.dictionary.to_pylist()], np.int64)
        term = known[words.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(self.ids)), col.value_lengths().to_numpy(zero_copy_only=False))
        tf = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        doc, term, tf = doc[term >= 0], term[term >= 0], tf[term >= 0]
        m = 25 + (75 * table.column("n").to_numpy() * n_docs) // n_terms
        self.term, self.impact = term, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.start = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        by = np.lexsort((-self.impact, term))
        self.listed, self.sorted = doc[by], self.impact[by]
        self.lists = np.searchsorted(term[by], np.arange(len(vocabulary) + 1))
        self.coef = np.zeros(len(vocabulary), np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Full scores by the forward index, under the weights in ``coef``; every document has a term."""
        start, size = self.start[docs], self.start[docs + 1] - self.start[docs]
        ahead = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(ahead - start, size)
        return np.add.reduceat(self.coef[self.term[at]] * self.impact[at], ahead)

    def top(self, terms: np.ndarray, coefs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for weighted terms and their scores."""
        start, end = self.lists[terms], self.lists[terms + 1]
        self.coef[terms] = coefs
        met = np.zeros(len(self.ids), bool)
        docs, score, depth, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        while True:
            reach = np.minimum(start + depth + step, end)
            read = [self.listed[s:e] for s, e in zip(start + depth, reach, strict=True) if s < e]
            if not read:
                break
            new = np.concatenate(read)
            new = np.unique(new[~met[new]])
            if len(new):
                met[new] = True
                docs, score = np.append(docs, new), np.append(score, self.scores(new))
                by = np.lexsort((self.ids[docs], -score))[:k]
                docs, score = docs[by], score[by]
            open_ = reach < end
            threshold = (coefs[open_] * self.sorted[reach[open_] - 1]).sum()
            if not open_.any() or len(score) == k and threshold < score[-1]:
                break
            depth, step = depth + step, step * 2
        self.coef[terms] = 0
        return docs[score > 0], score[score > 0]


def _ranked(n_docs: int, n_terms: int, k: int):
    def run(items: pa.Table, docs: pa.Table) -> pa.Table:
        asked = items.column("terms").to_pylist()
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for some in asked for t in some))}
        shard = Shard(docs, vocabulary, n_docs, n_terms)
        out = []
        for row, (some, coefs) in enumerate(zip(asked, items.column("coefs").to_pylist(), strict=True)):
            found, score = shard.top(np.array([vocabulary[t] for t in some], np.int64), np.array(coefs, np.int64), k)
            out.append((np.full(len(found), row), shard.ids[found], score))
        row, doc, score = (np.concatenate([np.zeros(0, np.int64), *y]) for y in (zip(*out, strict=True) if out else ((), (), ())))
        at = pa.array(row)
        return pa.table({"item": items.column("item").take(at), "item_id": items.column("item_id").take(at), "doc_id": pa.array(doc, mask=doc == NO_ID), "score": pa.array(score)})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item (a number for each row of ``items``), item_id, rank, doc_id and score."""
    spark, parts = docs.sparkSession, near_partitions(docs.sparkSession)
    items = materialize(counted(items, "item_id").withColumn("item", F.monotonically_increasing_id()), "items")
    bits = bitmap(items.select(F.explode("terms").alias("term")))
    index = materialize(counted(docs, "doc_id", bits), "forward")
    n_docs, n_terms, n_postings = index.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
    asked = materialize(weighted(items, index, n_docs), "weighted")
    n_asked = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    down = max(1, -(-n_docs // DOCS), math.ceil((n_postings or 0) / POSTINGS), min(parts, n_docs // FEW))
    across = max(1, -(-n_asked // TERMS))
    key = cell_key(down * across, parts)
    cell = key(F.col("r") * across + F.col("b")).alias("cell")
    left = asked.withColumn("b", (F.pmod(F.xxhash64("item"), F.lit(across))).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"))
    right = index.withColumn("r", (F.monotonically_increasing_id() % down).cast("int")).where(F.size("terms") > 0)
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("b"))
    cells = left.select(cell, "item", "item_id", "terms", "coefs").groupBy("cell").cogroup(right.select(cell, "doc_id", "n", "terms", "tfs").groupBy("cell"))
    found = cells.applyInArrow(_ranked(n_docs, n_terms or 1, k), "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark).select("item_id", "rank", "doc_id", "score")


SQL = """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM terms GROUP BY ALL
), docs AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(nn) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN docs USING (doc_id), total GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

"""Operator 3: near-duplicates by SimHash and Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: each is the majority of that bit over the
XXH64 (seed 42) of all its 3-word shingles. Two fingerprints link when at most
three bits differ; linked documents form components.

Finding the links (on distinct fingerprints only, so exact copies cost nothing):
cut the fingerprint into four 16-bit segments. With three errors or fewer, one
segment is free of errors, and of the two 24-bit halves of the other 48 bits one
has at most one error. So a key is an exact segment together with a nearby
Golay codeword of one half: 23 of its bits are decoded with the perfect [23,12]
code, both as they stand and with each bit flipped, which gives one codeword
index or six. Words one bit apart share an index. Candidates that share a key
are compared exactly; a bucket gives a spanning forest, never all pairs.

A bucket of more than ``BUCKET`` fingerprints is not linked in one task but dealt
out again, by its key and one of four 16-bit pieces, cut anew at each level: with
three errors one piece is free of them, so no link is lost. Fingerprints stay
together only if a piece holds none of the bits they differ in, which more than
``BUCKET`` hardly do once; what is left after ``LEVELS`` levels is linked as it is.

Defined edge cases: a null text is empty; a text without words has fingerprint
zero, which links like any other; a text of one or two words is one shingle;
repeated rows stay, each with its result, and of equal ids one text each joins its
component; a null id never becomes a component's id; a very long text is read in
``_CHUNK`` shingles at a time; other columns are ignored, and carried through the
stage whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blobs, fresh, materialize, near_partitions, slices
from .components import components

SEED, SHINGLE, ERRORS = 42, 3, 3
_CHUNK = 255 * 64
#: Rows read at a time, fingerprints that one task links as a bucket, and how often larger buckets are dealt out again.
POOL, BUCKET, LEVELS = 200_000, 50_000, 8
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def fingerprint(raw: bytes) -> int:
    """The SimHash of one text as an unsigned number."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[-n:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        some = slice(at, min(at + _CHUNK, n))
        part = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        for i in range(0, len(bits), 255):  # a byte counts up to 255
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc_id, ``extra`` columns and fp (the fingerprint as a signed long)."""
    keep = ["doc_id", *extra]

    def run(batches):
        for batch in slices(batches):
            got = np.array([fingerprint(x) for x in blobs(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(got)], [*keep, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of the top 12 bits, and the error pattern of each syndrome."""

    def rest(x):
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    top = np.array([rest(i << 11) for i in range(4096)], np.int64)
    bit = [1 << i for i in range(23)]
    error = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a + 1):
            for c in range(b + 1):
                e = 0
                for x in {a, b, c}:
                    e |= bit[x]
                error[rest(e)] = e
    return top, error


def decode(x: np.ndarray, code) -> np.ndarray:
    """Index (12 bits) of the only codeword within three bits of each word."""
    top, error = code
    return (x ^ error[top[x >> 11] ^ (x & 0x7FF)]) >> 11


def keys(fp: np.ndarray, code) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of all fuzzy keys of unsigned 64-bit fingerprints."""
    rows, out = [], []
    flips = np.array([0] + [1 << i for i in range(23)], np.int64)
    segs = [((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    for i in range(4):
        a, b, c = (segs[j] for j in range(4) if j != i)
        for half, word in enumerate(((a << 7) | (b >> 9), ((b & 0xFF) << 15) | (c >> 1))):  # 23 bits of each 24
            near = np.sort(decode(word[:, None] ^ flips, code), axis=1)
            fresh = np.ones(near.shape, bool)
            fresh[:, 1:] = near[:, 1:] != near[:, :-1]
            at = np.nonzero(fresh)
            rows.append(at[0])
            out.append((((i * 2 + half) << 28) | (segs[i][at[0]] << 12)) | near[at])
    return np.concatenate(rows), np.concatenate(out)


def _emit_keys(batches):
    code = _golay()
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 5000):
            part = fp[at : at + 5000]
            rows, key = keys(part.view(np.uint64), code)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows])], ["k", "fp"])


def forest(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints."""
    rest, edges = fp.view(np.uint64), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            p = todo.pop()
            near = np.bitwise_count(rest ^ p) <= ERRORS
            if near.any():
                hits = rest[near]
                rest = rest[~near]
                todo.extend(hits)
                edges.append((np.full(len(hits), p), hits))
    return edges


def _masks(level: int) -> np.ndarray:
    """Four masks of 16 bits that share out the 64 bits, others at every level."""
    bits = np.uint64(1) << np.random.default_rng(level).permutation(64).astype(np.uint64)
    return np.bitwise_or.reduce(bits.reshape(4, 16), axis=1)


def _split(level: int):
    """Keys of the next level for buckets (k, fp) that are too large."""
    masks = _masks(level)

    def run(batches):
        for batch in batches:
            k, fp = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            for i, mask in enumerate(masks):
                x = (k + np.uint64(i)) * _MULT[0] ^ (fp & mask) * _MULT[1]
                x = (x ^ x >> np.uint64(29)) * _MULT[0]
                yield pa.RecordBatch.from_arrays([pa.array((x ^ x >> np.uint64(32)).view(np.int64)), pa.array(fp.view(np.int64))], ["k", "fp"])

    return run


def _met(u: np.ndarray, v: np.ndarray, large: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), large)), pa.array(u), pa.array(v)], ["large", "u", "v"])


def _link(most: int | None):
    """Links within the runs of equal keys of a sorted partition; runs over ``most`` come back as (key, fp) rows."""

    def solve(k, f):
        cuts = np.flatnonzero(np.diff(k)) + 1
        start = np.concatenate([[0], cuts])
        n = np.diff(np.concatenate([start, [len(k)]]))
        two = start[n == 2]
        u, v = f[two], f[two + 1]
        ok = np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= ERRORS
        out = [(u[ok], v[ok])]
        for s, m in zip(start[n > 2], n[n > 2], strict=True):
            if most and m > most:
                yield _met(k[s : s + m], f[s : s + m], True)
            else:
                out += [(a.view(np.int64), b.view(np.int64)) for a, b in forest(np.ascontiguousarray(f[s : s + m]))]
        yield _met(*(np.concatenate(x) for x in zip(*out, strict=True)), False)

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pool_k, pool_f, size, large = [], [], 0, None

        def taken():
            """The pooled rows, without those of the bucket that is already too large."""
            k, f = np.concatenate([held_k, *pool_k]), np.concatenate([held_f, *pool_f])
            cut = 0 if large is None else int(np.searchsorted(k, large, "right"))
            return k[cut:], f[cut:], _met(k[:cut], f[:cut], True)

        for batch in batches:
            pool_k.append(batch.column(0).to_numpy(zero_copy_only=False))
            pool_f.append(batch.column(1).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size < POOL:
                continue
            k, f, more = taken()
            yield more
            pool_k, pool_f, size = [], [], 0
            last = np.searchsorted(k, k[-1]) if len(k) else 0  # the last run may go on in the next batch
            if last:
                yield from solve(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
            if most and len(held_k) > most:
                large = held_k[0]
                yield _met(held_k, held_f, True)
                held_k, held_f = held_k[:0], held_f[:0]
        k, f, more = taken()
        yield more
        if len(k):
            yield from solve(k, f)

    return run


def links(distinct: DataFrame, most: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) as far as they link."""
    n, level, done = near_partitions(distinct.sparkSession), 0, None
    sent = distinct.select("fp").mapInArrow(_emit_keys, "k long, fp long")
    while True:
        met = sent.repartition(n, "k").sortWithinPartitions("k").mapInArrow(_link(most if level < LEVELS else None), "large boolean, u long, v long")
        met = materialize(met, "links")
        found, rest, level = met.where("not large").select("u", "v"), met.where("large").select("u", "v"), level + 1
        done = done.unionByName(found) if done else found
        if rest.isEmpty():
            return done
        sent = rest.mapInArrow(_split(level), "k long, fp long")


def group(prints: DataFrame) -> DataFrame:
    """fp, component_id and c (a fingerprint that names the component) for each distinct fingerprint of (doc_id, fp) rows."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    parts = components(links(nodes)).withColumnRenamed("node", "fp")
    inside = materialize(nodes.join(parts, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c")), "fpc")
    least = inside.groupBy("c").agg(F.min("first").alias("component_id"))
    return inside.join(least, "c").select("fp", "component_id", "c")


def op3(docs: DataFrame) -> DataFrame:
    prints = materialize(fingerprints(docs), "prints")
    return prints.join(group(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _leaders(rows: DataFrame) -> DataFrame:
    """Of rows (c, id, mark) one for each component c, and one for each id at most.

    A component's smallest (id, mark) leads it. An id that leads several keeps the one
    with the smallest mark; the others are led by their next id that leads none, if any,
    in further rounds. Where no id has several texts, the first round settles all.
    """
    open_, led = rows, None
    while True:
        first = open_.groupBy("c").agg(F.min(F.struct("id", "mark")).alias("x")).select("c", "x.*")
        won = first.groupBy("id").agg(F.min(F.struct("mark", "c")).alias("x")).select("id", "x.*")
        won = materialize(won, "leaders")
        led = led.unionByName(won) if led else won
        rest = open_.join(won.select("c"), "c", "left_anti").join(won.select("id"), "id", "left_anti")
        open_ = materialize(rest.select("c", "id", "mark"), "open")
        if open_.isEmpty():
            return led.select("id", "mark")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with the smallest id.

    A row is an id with its text. Rows that repeat an id with another text are versions
    of one document, of which one stays: each is judged in the component of its own
    text, and a component whose smallest id stays with another version goes on to its
    next id. So a text is only lost where all ids that have it, or a near copy of it,
    stay with another version. Of rows that repeat id and text one stays. Rows without
    an id cannot be told apart and stay.
    """
    mark, turn, id_ = (fresh(docs, c) for c in ("dup_mark", "dup_turn", "dup_id"))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    prints = materialize(fingerprints(marked, [mark]), "prints")
    rows = prints.where("doc_id is not null").select("fp", F.col("doc_id").alias("id"), F.col(mark).alias("mark")).distinct()
    rows = materialize(rows.join(group(prints).select("fp", "c"), "fp").select("c", "id", "mark"), "versions")
    best = _leaders(rows).toDF(id_, f"{id_}_mark")
    known = marked.join(best, (F.col("doc_id") == F.col(id_)) & (F.col(mark) == F.col(f"{id_}_mark")), "left_semi")
    known = known.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(mark))).where(F.col(turn) == 1)
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))

"""Operator 4: substring deduplication by relative Lempel-Ziv factors.

Every document is factored against indexed blocks of reference text, which hold the
documents with smaller ids: from left to right, the longest stretch that one
reference text has as well becomes a factor, and behind its end the index is asked
again. Factors have ``window`` words at least; what they cover is a duplicate span.

A whole reference has no single index, so it is cut into blocks by content. A
window's anchor is the smallest hash among its 5-word grams; neighbouring windows
mostly share it. The map side cuts texts into runs of windows with one anchor and
sends each run, packed, to the block of the anchor, as reference and to be factored.
Windows with equal words have equal anchors and meet in one block; a factor that
crosses an anchor's end comes out in pieces that overlap, and windows over a factor's
boundary are looked up like all others, so no window is lost. A block's index knows
the first place of each window in the smallest document.

A map batch is a block of its own first: it factors its documents against each other,
and only the smallest document of equal windows goes on, so a passage that a third
of all documents share reaches its block once a batch. There are as many blocks as the
texts' bytes ask for, so that one holds a quarter of ``BLOCK_BYTES`` on average. A block
that gets more than ``BLOCK_BYTES`` (a frequent anchor) is not indexed but dealt out
again window by window, over all tasks and twice as many blocks each time, until every
block fits.

Words are compared by hashes: 56 bits of the window, 32 of the anchor and the number
of the block, from independent 64-bit hashes of all 13 and of 5 of its words.

Defined edge cases: a null text has no words; documents under ``window`` words
keep all; a null id sorts after all others, and texts without one are told apart by
a 48-bit hash; rows that repeat an id are judged alike and never against each other,
also where their texts differ; a very long text is one row of a batch of its own; an
empty table gives an empty result; other columns are ignored, and carried through
the stage whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Memo, blobs, even_keys, fresh, ids, materialize, near_partitions, slices, sweep

WINDOW, GRAM, BATCH_BYTES, BLOCK_BYTES = 13, 5, 2 << 20, 16 << 20
#: Bytes of text for a partition, and bytes that a byte of text takes as windows (short words) at most.
PARTITION_BYTES, SENT_BYTES = 32 << 20, 2
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Rows between tasks: runs of windows for a block and its part, or finished factors.
RUNS, FACTORS = 0, 1
SENT = "block int, part int, kind int, blob binary"


def _slide(h: np.ndarray, width: int, mult: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes."""
    n, m = len(h) - width + 1, np.uint64(mult)
    out = h[:n].copy()
    for j in range(1, width):
        out *= m
        out += h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _packed(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw, width: int) -> np.ndarray:
    raw = (np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Marks rows that differ from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Windows:
    """Windows of a block, by document, text and place: document, hash of its text, place, anchor and hash of the window."""

    def __init__(self, doc, tag, pos, anchor, win):
        self.columns = (doc, tag, pos, anchor, win)
        self.doc, self.tag, self.pos, self.anchor, self.win = self.columns

    def take(self, rows) -> Windows:
        return Windows(*(c[rows] for c in self.columns))

    def factor(self, blocked: bool = True):
        """(rows that are in no factor, factors): each factor as document, text, start, number of windows and reference.

        The index is the windows in order; the first of equal ones stands in the smallest
        document. A factor goes on while the next window has the next place of one reference.
        """
        order = np.lexsort((self.win, self.anchor)) if blocked else np.argsort(self.win << np.uint64(8) | self.anchor & np.uint64(255), kind="stable")
        new = _changes(self.anchor[order], self.win[order])
        first = np.empty(len(order), np.int32)  # the reference place of each window
        first[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
        del order, new
        found = self.doc > self.doc[first]
        rows = np.flatnonzero(found)
        if blocked:  # rows that repeat a document, text and all, are found once
            rows = rows[_changes(self.doc[rows], self.tag[rows], self.pos[rows])]
        source, step = first[rows], np.arange(len(rows))
        doc, tag, pos = self.doc[rows], self.tag[rows], self.pos[rows]
        starts = np.flatnonzero(_changes(doc, tag, pos - step, self.doc[source], self.tag[source], self.pos[source] - step))
        n = np.diff(np.append(starts, len(rows)))
        return np.flatnonzero(~found), (doc[starts], tag[starts], pos[starts], n, self.doc[source[starts]])

    def rows(self, keys: list[int], cell: np.ndarray):
        """Packed runs for each cell (a part of a block); runs are neighbours with one anchor, as they stand in order."""
        new = _changes(self.doc, self.tag, self.pos - np.arange(len(self.pos)), self.anchor, cell)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        first = np.flatnonzero(new | ((np.arange(len(new)) - head) % 255 == 0))  # a length fits a byte
        length = np.diff(np.append(first, len(new)))
        to = cell[first]
        by = np.argsort(to, kind="stable")
        edge = np.flatnonzero(np.append(_changes(to[by]), True)) if len(by) else []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            f, n = first[by[lo:hi]], length[by[lo:hi]]
            text = np.flatnonzero(_changes(self.doc[f], self.tag[f]))  # a text's runs stand together
            ref = np.repeat(np.arange(len(text)), np.diff(np.append(text, len(f))))
            each = np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum())
            parts = [np.array([len(text), len(f)], "<u4"), self.doc[f[text]].astype("<i8"), ref.astype("<u4"), self.pos[f].astype("<u4"), n.astype(np.uint8)]
            part, block = divmod(int(cell[f[0]]), len(keys))
            yield _row(keys[block], part, RUNS, b"".join([*(x.tobytes() for x in parts), _packed(self.tag[f[text]], 6), _packed(self.anchor[f], 4), _packed(self.win[each], 7)]))


def _read(found: list[bytes], shared: bool = False) -> Windows:
    """The windows of packed runs; ``shared``: only of runs whose anchor several documents have."""
    parts = []
    for raw in found:
        d, r = (int(x) for x in np.frombuffer(raw, "<u4", 2))
        at, columns = 8, []
        for kind, n in (("<i8", d), ("<u4", r), ("<u4", r), (np.uint8, r)):
            columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        doc, ref, pos, n = columns
        tag, anchor = _unpacked(raw[at : at + 6 * d], 6).astype(np.int64), _unpacked(raw[at + 6 * d : at + 6 * d + 4 * r], 4)
        parts.append((doc[ref], tag[ref], pos, n, anchor, np.frombuffer(raw, np.uint8, -1, at + 6 * d + 4 * r).reshape(-1, 7)))
    doc, tag, pos, n, anchor, win = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = n.astype(np.int64)
    first, runs = np.cumsum(n) - n, np.lexsort((pos, tag, doc))
    if shared:
        order = np.argsort(anchor, kind="stable")
        new = np.flatnonzero(_changes(anchor[order]))
        d = doc[order]
        several = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)
        several_docs = np.zeros(len(order), bool)
        several_docs[order] = np.repeat(several, np.diff(np.append(new, len(order))))
        runs = runs[several_docs[runs]]
    n = n[runs]
    run = np.repeat(runs, n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    return Windows(doc[run], tag[run], pos[run].astype(np.int64) + step, anchor[run], _unpacked(win[first[run] + step], 7))


def _row(block: int, part: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["block", "part", "kind", "blob"])


def _factors(factors, block: int):
    if len(factors[0]):
        yield _row(block, 0, FACTORS, b"".join([np.array([len(factors[0])], "<u4").tobytes(), *(x.astype("<i8").tobytes() for x in factors)]))


def _cells(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def _explore(keys: list[int], parts: int, width: int):
    """Texts as windows, those of a batch factored against each other, the rest sent to the blocks of their anchors."""
    n_blocks = len(keys)

    def run(batches):
        memo = Memo(xxhash.xxh64_intdigest)
        for turn, batch in enumerate(slices(batches, most=BATCH_BYTES)):
            doc_ids, texts = ids(batch), blobs(batch)
            tags = batch.column(batch.schema.get_field_index("tag")).to_numpy(zero_copy_only=False)
            by = np.lexsort((tags, doc_ids))
            doc_ids, tags, words = doc_ids[by], tags[by], [texts[i].split() for i in by]
            del texts
            n = np.fromiter(map(len, words), np.int64, len(words))
            if n.max() < width:
                continue
            h = np.fromiter((memo[w] for ws in words for w in ws), np.uint64, int(n.sum()))
            del words
            held = np.maximum(n - width + 1, 0)
            row = np.repeat(np.arange(len(n)), held)  # the row of each window
            at = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
            place = (np.cumsum(n) - n)[row] + at
            win = _slide(h, width, _MULT[0])[place] >> np.uint64(8)
            gram = _slide(h, GRAM, _MULT[1])
            m = len(gram) - (width - GRAM)
            least = gram[:m].copy()
            for j in range(1, width - GRAM + 1):
                np.minimum(least, gram[j : j + m], out=least)
            anchor = least[place]
            del gram, least, h, place
            cell = _cells(anchor >> np.uint64(32), n_blocks * parts)
            here = Windows(doc_ids[row], tags[row], at, anchor & np.uint64(0xFFFFFFFF), win)
            stay, factors = here.factor(False)
            yield from _factors(factors, keys[turn % n_blocks])
            if len(stay):
                yield from here.take(stay).rows(keys, cell[stay])

    return run


def _settle(keys: list[int], parts: int, level: int):
    """Rows sorted by block and part: factors each part, or deals it out by window if it is too large."""
    n_cells, mult = len(keys) * parts << level + 1, np.uint64(_MULT[0] + 2 * level)

    def deal(found):
        here = _read(found)
        stay, factors = here.factor()
        yield from _factors(factors, keys[0])
        rest = here.take(stay)
        yield from rest.rows(keys, _cells(rest.win * mult >> np.uint64(32), n_cells))

    def finish(found, large):
        yield from deal(found) if large else _factors(_read(found, shared=True).factor()[1], keys[0])

    def run(batches):
        now, found, size, large = None, [], 0, False
        for batch in batches:
            for block, part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == FACTORS:
                    yield _row(block, part, kind, blob)
                    continue
                if (block, part) != now:
                    if found:
                        yield from finish(found, large)
                    now, found, size, large = (block, part), [], 0, False
                found.append(blob)
                size += len(blob)
                if size > BLOCK_BYTES:
                    yield from deal(found)
                    found, size, large = [], 0, True
        if found:
            yield from finish(found, large)

    return run


def _unfolded(batches):
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            x = np.frombuffer(blob, "<i8", -1, 4).reshape(5, -1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["id", "tag", "start", "n", "reference"])


def _grid(docs: DataFrame) -> tuple[int, int]:
    """Partitions, and parts of each one's block: both grow with the texts, so that no block does."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(near_partitions(docs.sparkSession), math.ceil(size / PARTITION_BYTES))
    return n, math.ceil(size * SENT_BYTES / n / (BLOCK_BYTES / 4)) or 1


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, tag (of the text), start (word), n (windows) and reference (a smaller id) of each factor."""
    n, parts = _grid(docs)
    keys = even_keys(n)
    text = docs.select("doc_id", "text", _tag())
    sent, level, done = text.mapInArrow(_explore(keys, parts, window), SENT), 0, []
    while True:
        # Dealt to partitions, one block each; its parts follow one another.
        sent = sent.repartition(len(keys), "block").sortWithinPartitions("block", "part").mapInArrow(_settle(keys, parts, level), SENT)
        met = materialize(sent, "factors")
        done.append(met.where(F.col("kind") == FACTORS).select("blob"))
        sent, level = met.where(F.col("kind") == RUNS), level + 1
        last = sent.isEmpty()
        sweep(docs.sparkSession)  # the windows' shuffle is larger than the texts, and read for the last time
        if last:
            break
    out = done[0]
    for more in done[1:]:  # a handful at most: every level deals by further bits of the windows
        out = out.unionByName(more)
    return out.mapInArrow(_unfolded, "id long, tag long, start long, n long, reference long")


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, tag (of the text) and runs: starts and numbers of windows that a smaller id has."""
    return factors(docs, window).groupBy("id", "tag").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def _tag():
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 16).alias("tag")


def _cut(keep: list[str], names: list[str], window: int):
    def run(batches):
        for batch in slices(batches):
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n_words, n_gone, kept = [], [], []
            for raw, runs in zip(blobs(batch), col[names[0]].to_pylist(), strict=True):
                words = raw.split()
                n_words.append(len(words))
                if not runs:
                    n_gone.append(0)
                    kept.append(b" ".join(words).decode())
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    edge[r["start"]] += 1
                    edge[r["start"] + r["n"] + window - 1] -= 1
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                n_gone.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay]).decode())
            yield pa.RecordBatch.from_arrays([*(col[c] for c in keep), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], [*keep, *names[1:]])

    return run


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, one space apart."""
    return _deduped(docs, [], window)[0].toDF("doc_id", "n_words", "n_removed", "kept")


def _deduped(docs: DataFrame, extra: list[str], window: int) -> tuple[DataFrame, list[str]]:
    """doc_id, ``extra`` columns, and three columns (their names are given): words, removed words, kept text."""
    keep = ["doc_id", *extra]
    names = [fresh(docs, c) for c in ("rlz_runs", "rlz_words", "rlz_removed", "rlz_kept")]
    id_, tag, id2, tag2 = (fresh(docs, c) for c in ("rlz_id", "rlz_tag", "rlz_id2", "rlz_tag2"))
    rows = docs.select(*dict.fromkeys([*keep, "text"]), F.coalesce("doc_id", F.lit(int(NO_ID))).alias(id_), _tag().alias(tag))
    got = spans(docs, window).toDF(id2, tag2, names[0])
    rows = rows.join(got, (F.col(id_) == F.col(id2)) & (F.col(tag) == F.col(tag2)), "left").select(*dict.fromkeys([*keep, "text"]), names[0])
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", {} long, {} long, {} string".format(*names[1:])
    return rows.mapInArrow(_cut(keep, names, window), schema), names[1:]


def op4(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage: duplicate spans leave the texts; rows without any stay as they are.

    A text that lost words holds the others one space apart, and n_chars follows.
    """
    got, (_, removed, kept) = _deduped(docs, [c for c in docs.columns if c != "doc_id"], WINDOW)
    changed = F.col(removed) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return got.select(*(new[c].alias(c) if c in new else c for c in docs.columns))

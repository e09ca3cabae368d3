"""Operator 10: benchmark decontamination.

Method: rare seeds join documents to items, then Smith-Waterman aligns an item with
every part of a document that can reach the score. Matches are worth ``MATCH`` and
every other word of the aligned part costs one at least, so a part of s words with
m of the item's words (each counted as often as the item has it) scores at most
2 m - (s - m). The score is the alignment's share of the item's perfect score;
copies with words changed, added or left out score lower, and ``least`` separates
them from chance.

Seeds are an item's rarest words (grams of one word), as many as an alignment that
reaches the score cannot do without: of k words at least ceil(``least`` k) must be
there, so one of the k - ceil(``least`` k) + 1 rarest is. Longer grams would be
rarer, but a copy with every third word changed holds no gram of three; with these
seeds the search is exact whatever was edited. Rarity is counted over the items.
Candidates are then tested as bags of words and by the number of the item's words
in windows of several lengths (``LEVELS``); both tests are exact as well.

Items are read in blocks of at most ``BLOCK_WORDS`` words, each sent to all
tasks; a larger benchmark takes more passes, not more memory.

Words are runs of letters, digits and underscores, lower-cased. Defined edge
cases: null or empty texts hold no item; items under ``MIN_WORDS`` words match
only as they stand, those under ``SURE`` words only as a whole document; items
without words never match; rows that repeat an id are judged one by one, of equal
alignments the first place counts; a null document id is carried through; an item
without an id cannot be reported in a pair, but ``clean`` drops the documents that
hold it; a very long text is searched in overlapping parts; an empty benchmark
matches nothing, an empty table gives an empty result; other columns are ignored,
and carried through ``clean`` whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

MIN_WORDS, SURE, LEAST, BLOCK_WORDS = 8, 3, 0.5, 1_000_000
#: Window lengths of the bound; words of a text that are tested together; cells of a table of windows.
LEVELS, SEGMENT, CELLS = 6, 512, 1 << 18
MATCH, MISS, GAP = 2, -1, 1
TOKEN = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


@dataclass
class Index:
    """Items of one block: their words as numbers, which of them seed, and the short items."""

    vocab: dict[str, int]
    ids: list[int | None]
    items: list[np.ndarray]
    size: np.ndarray
    own_start: np.ndarray  # the distinct words of item i are own_start[i]:own_start[i + 1]
    word: np.ndarray
    times: np.ndarray  # how often the item holds the word
    short: dict[str, list[tuple[list[str], int | None]]] = field(default_factory=dict)  # by first word
    seeded: dict[float, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def seeds(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(start, items): word w seeds items[start[w]:start[w + 1]]."""
        if least not in self.seeded:
            width, item = len(self.vocab) + 1, np.repeat(np.arange(len(self.items)), np.diff(self.own_start))
            holders = np.bincount(self.word, minlength=width)
            by = np.lexsort((self.word, holders[self.word], item))  # each item's rarest words first
            before = np.cumsum(self.times[by]) - self.times[by]
            before -= np.repeat(before[self.own_start[:-1]], np.diff(self.own_start))
            some = by[before <= (self.size - _ceil(least * self.size))[item[by]]]  # what comes later cannot reach the score alone
            some = some[np.lexsort((item[some], self.word[some]))]
            self.seeded[least] = np.searchsorted(self.word[some], np.arange(width + 1)), item[some]
        return self.seeded[least]


def build(ids: list[int | None], items: list[list[str]]) -> Index:
    vocab: dict[str, int] = {}
    nums = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int64) for ws in items]
    size = np.array([len(x) for x in nums], np.int64)
    width = len(vocab) + 1
    keys = np.concatenate([np.zeros(0, np.int64), *(i * width + x for i, x in enumerate(nums))])
    keys, times = np.unique(keys, return_counts=True)
    return Index(vocab, ids, nums, size, np.searchsorted(keys // width, np.arange(len(nums) + 1)), keys % width, times)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges first[i] : first[i] + n[i] after one another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _floor(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 1e-9).astype(np.int64)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def regions(index: Index, nums: np.ndarray, least: float):
    """(item number, start, end) of the parts of a text that can reach the score, by item and place."""
    order = np.argsort(nums, kind="stable")
    order = order[np.searchsorted(nums[order], 1) :]  # places of known words, by word
    if not len(order):
        return
    held = nums[order]
    head = np.flatnonzero(np.diff(held, prepend=0))
    word, n = held[head], np.diff(head, append=len(held))
    first, seeded = index.seeds(least)
    joined = np.unique(seeded[_spread(first[word], first[word + 1] - first[word])])
    if not len(joined):
        return
    wide = index.own_start[joined + 1] - index.own_start[joined]
    at = _spread(index.own_start[joined], wide)
    which = np.minimum(np.searchsorted(word, index.word[at]), len(word) - 1)
    there = word[which] == index.word[at]
    item, times, which = np.repeat(joined, wide)[there], index.times[at][there], which[there]
    bag = np.bincount(item, np.minimum(n[which], times), len(index.items))
    able = np.flatnonzero(bag >= _ceil(least * index.size))
    width = len(nums) + 1
    edges = [least * (max(least, 3 - 2 * least) / least) ** (k / LEVELS) for k in range(LEVELS + 1)]
    for some in np.split(able, range(max(1, CELLS // width), len(able), max(1, CELLS // width))):
        if not len(some):
            continue
        row = np.full(len(index.items), -1)
        row[some] = np.arange(len(some))
        mine = row[item] >= 0
        w, t, r = which[mine], times[mine], row[item[mine]]
        k = _spread(head[w], n[w])
        w, t, r = np.repeat(w, n[w]), np.repeat(t, n[w]), np.repeat(r, n[w])
        place = order[k]
        # A place counts in windows that begin after the same word's place ``times`` before.
        before = np.where(k - head[w] >= t, order[np.maximum(k - t, 0)], -1)
        size, found = index.size[some], []

        def windows(span, need):
            begin = np.maximum(before, place - span[r]) + 1
            cells = len(some) * width
            held = np.cumsum(np.bincount(r * width + begin, minlength=cells) - np.bincount(r * width + place + 1, minlength=cells)).reshape(-1, width)
            return held >= need[:, None]

        # First the longest part that an alignment can take, with the fewest words.
        ok = windows(_floor(edges[-1] * size), _ceil(least * size)).any(axis=1)
        if not ok.any():
            continue
        kept = ok[r]
        r, place, before = (np.cumsum(ok) - 1)[r[kept]], place[kept], before[kept]
        some, size = some[ok], size[ok]
        for low, high in zip([0.0, *edges[1:-1]], edges[1:], strict=True):
            span = _floor(high * size)
            rows, starts = np.nonzero(windows(span, _ceil(np.maximum(least * size, (2 * least + low) * size / 3))))
            found.append((rows, starts, np.minimum(starts + span[rows], len(nums))))
        rows, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((starts, rows))
        last = None
        for i, a, b in zip(some[rows[by]].tolist(), starts[by].tolist(), ends[by].tolist(), strict=True):
            if last and last[0] == i and a <= last[2]:
                last[2] = max(last[2], b)
            else:
                if last:
                    yield tuple(last)
                last = [i, a, b]
        if last:
            yield tuple(last)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the position after its last word in ``text``."""
    ramp = GAP * np.arange(len(text) + 1)
    last = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(last[:-1] + np.where(text == w, MATCH, MISS), last[1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps along the text
        if row.max() > best:
            best, end = int(row.max()), int(row.argmax())
        last = row
    return best, end


def match(index: Index, text: str | None, least: float) -> list[tuple[int | None, float, int, int]]:
    """(item id, score, start, end) of every item that the text holds a copy of."""
    got = words(text)
    out = _whole(index, got) if index.short else []
    if not index.items:
        return out
    get = index.vocab.get
    nums = np.fromiter((get(w, 0) for w in got), np.int64, len(got))
    best: dict[int, tuple[float, int, int]] = {}
    longest = int((3 - 2 * least) * index.size.max()) + 1  # words of a text that a copy can take
    step = max(SEGMENT, 4 * longest)
    for at in range(0, max(1, len(nums) - longest), step - longest):
        part = nums[at : at + step]
        for i, lo, hi in regions(index, part, least):
            size = int(index.size[i])
            got, end = align(index.items[i], part[lo:hi])
            score = got / (MATCH * size)
            if score >= least and score > best.get(i, (0.0,))[0]:
                best[i] = (score, at + max(lo, lo + end - size), at + lo + end)
    return out + [(index.ids[i], *v) for i, v in sorted(best.items())]


def _whole(index: Index, got: list[str]) -> list[tuple[int | None, float, int, int]]:
    """The first place of every short item."""
    out = {}
    for at, w in enumerate(got):
        for k, (ws, i) in enumerate(index.short.get(w, ())):
            if (w, k) not in out and got[at : at + len(ws)] == ws and (len(ws) >= SURE or len(ws) == len(got)):
                out[w, k] = (i, 1.0, at, at + len(ws))
    return list(out.values())


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS, *, least: float = LEAST, nameless: bool = False):
    """Indexes over the items (``nameless``: also those without an id), in blocks of a bounded number of words."""
    held, size = [], 0
    rows = benchmark.select("item_id", "text")
    for row in (rows if nameless else rows.where("item_id is not null")).orderBy("item_id", "text").toLocalIterator():
        got = words(row["text"])
        if not got:
            continue
        if held and size + len(got) > most:
            yield _block(held, least)
            held, size = [], 0
        held.append((row["item_id"], got))
        size += len(got)
    if held:
        yield _block(held, least)


def _block(held: list[tuple[int | None, list[str]]], least: float) -> Index:
    long = [(i, ws) for i, ws in held if len(ws) >= MIN_WORDS]
    index = build([i for i, _ in long], [ws for _, ws in long])
    for i, ws in held:
        if len(ws) < MIN_WORDS:
            index.short.setdefault(ws[0], []).append((ws, i))
    index.seeds(least)  # found once, and sent along
    return index


PAIRS = "doc_id long, item_id long, score double, word_start long, word_end long"


def find(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, word_start, word_end) of each copy; repeats of a pair in one row of docs appear once, at the best place."""
    out = None
    for index in blocks(benchmark, least=least):
        got = docs.select("doc_id", "text").mapInArrow(_pairs(index, least), PAIRS)
        out = got if out is None else out.union(got)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def _pairs(index: Index, least: float):
    def run(batches):
        for batch in slices(batches):
            rows = [(d, *m) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in match(index, text, least)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "word_start", "word_end"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Pipeline stage: documents that hold a copy of a benchmark item go."""
    schema, out = docs.schema, docs
    for index in blocks(benchmark, least=least, nameless=True):
        out = out.mapInArrow(_without(index, least), schema)
    return out


def _without(index: Index, least: float):
    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not match(index, text, least) for text in texts], pa.bool_()))

    return run

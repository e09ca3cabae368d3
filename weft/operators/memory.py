"""Long-term memory: keyword search with decay, and merges into topics and profiles."""

from __future__ import annotations

import heapq
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.prose_json import balanced
from weft.functions.text import char_jaccard, days_since, keyword_match, memory_keywords, memory_score, text_match

MOST_ENTRIES, EXPIRY_DAYS, SIMILAR = 10, 90, 0.8
OTHER = "其他"


def search(topics: DataFrame, entries: DataFrame, query: str, as_of: str, k: int = 5) -> DataFrame:
    """The k best entries for a query.

    ``topics``: slug, topic_pos, title, keywords; ``entries``: slug, pos, title,
    text, date. Scores over zero only; ties keep the topics' and entries' order.
    Topics without entries, and entries without a topic, drop out.
    """
    topic = topics.select("slug", "topic_pos", F.col("title").alias("topic"), keyword_match(memory_keywords(F.lit(query)), F.col("keywords")).alias("topic_match"))
    # Entries are scored before the join, so that it moves no texts. A title that is the text's first line is not read twice.
    opens = (F.col("text") == F.col("title")) | F.startswith("text", F.concat("title", F.lit("\n")))
    entry = text_match(query, F.when(opens, F.col("text")).otherwise(F.concat_ws(" ", "title", "text")))
    rows = entries.select("slug", "pos", "title", "date", entry.alias("entry_match")).join(topic, "slug")
    raw = memory_score(F.col("topic_match"), F.col("entry_match"), days_since("date", as_of))
    rows = rows.withColumn("raw", raw).where("raw > 0")
    best = rows.orderBy(F.desc("raw"), "topic_pos", "pos").limit(k)
    return best.select("slug", "topic", "pos", "title", "date", F.round("raw", 3).alias("score"), "raw", "topic_pos")


def touch(topics: DataFrame, hits: DataFrame, as_of: str) -> DataFrame:
    """Sets last_accessed_at on the topics that a search returned."""
    seen = hits.select("slug").distinct().withColumn("__hit", F.lit(True))
    return topics.join(seen, "slug", "left").withColumn("last_accessed_at", F.when(F.col("__hit"), F.lit(as_of)).otherwise(F.col("last_accessed_at"))).drop("__hit")


def mark_stale(preferences: DataFrame, as_of: str, days: int = EXPIRY_DAYS) -> DataFrame:
    """Preferences not updated for more than ``days`` are stale, with confidence one half."""
    old = days_since("updated_at", as_of, 999.0) > days
    return preferences.withColumns({"stale": F.when(old, True).otherwise(F.col("stale")), "confidence": F.when(old, 0.5).otherwise(F.col("confidence"))})


BLOCK_CHARS, MOST_AT_ONCE = 1 << 20, 1 << 22


def _blocks(texts: list[str]) -> list[list[int]]:
    """The numbers of all texts that are neither null nor empty, longest first, in blocks of ``BLOCK_CHARS``."""
    blocks, room = [], 0
    for i in sorted((i for i, x in enumerate(texts) if x), key=lambda i: -len(texts[i])):
        if room < len(texts[i]):
            blocks.append([])
            room = max(BLOCK_CHARS, len(texts[i]))
        blocks[-1].append(i)
        room -= len(texts[i])
    return blocks


def _hashes(block: list[int], texts: list[str], size: np.ndarray):
    """(n, start, h) for n = 1, 2, 4 ...: the hash of the n characters at each place of the joined texts, as far
    as texts have n. ``start``: where these texts begin. A hash comes from two of half the length."""
    h = (np.frombuffer("".join(texts[i] for i in block).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    lengths, n, by = size[block], 1, 0xD6E8FEB86659FD93
    while len(lengths):
        yield n, np.cumsum(lengths) - lengths, h
        lengths = lengths[lengths >= 2 * n]  # the longest come first
        h = h[: lengths.sum()]
        h = h[:-n] * np.uint64(by) + h[n:] if len(h) else h
        n, by = 2 * n, (by * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EA) % 2**64 | 1


def related(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, others): others[starts[i] : starts[i + 1]] are the numbers of those of the distinct texts
    that text i contains or that contain it, itself too.

    With n the largest power of two that a text is long, it is its first n and its last n
    characters. It is looked up in the others by the hashes of both, at their distance, for all
    places of a block of texts at once; what is found is verified. Null is related to none.
    """
    size = np.array([len(x) if x else 0 for x in texts], np.int64)
    level = np.array([1 << (k.bit_length() - 1) if k else 0 for k in size.tolist()], np.int64)
    head, tail = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    blocks = _blocks(texts)
    for block in blocks:
        for n, start, h in _hashes(block, texts, size):
            at = np.flatnonzero(level[block[: len(start)]] == n)
            mine = np.array(block, np.int64)[at]
            head[mine], tail[mine] = h[start[at]], h[start[at] + size[mine] - n]
    index = {}
    for n in np.unique(level[level > 0]).tolist():
        mine = np.flatnonzero(level == n)
        mine = mine[np.argsort(head[mine], kind="stable")]
        heads, first, count = np.unique(head[mine], return_index=True, return_counts=True)
        bits = max(12, (64 * len(heads)).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[heads >> np.uint64(64 - bits)] = True
        index[n] = mine, heads, first, count, seen, np.uint64(64 - bits)
    inner, outer = [], []
    for block in blocks:
        numbers = np.array(block, np.int64)
        for n, start, h in _hashes(block, texts, size):
            if n not in index:
                continue
            mine, heads, first, count, seen, shift = index[n]
            at = np.flatnonzero(seen[h >> shift])
            group = np.minimum(np.searchsorted(heads, h[at]), len(heads) - 1)
            same = heads[group] == h[at]
            at, group = at[same], group[same]
            total = np.cumsum(count[group])
            cuts = [*np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, MOST_AT_ONCE))).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                many = count[group[lo:hi]]
                place = np.repeat(at[lo:hi], many)
                a = mine[np.repeat(first[group[lo:hi]] - np.cumsum(many) + many, many) + np.arange(len(place))]
                b = np.searchsorted(start, place, "right") - 1
                end = place + size[a]
                fits = (end <= start[b] + size[numbers[b]]) & (a != numbers[b])
                place, a, b, end = place[fits], a[fits], b[fits], end[fits]
                fits = h[end - n] == tail[a]
                place, a, b = place[fits], a[fits], b[fits]
                _, once = np.unique(a * len(texts) + b, return_index=True)
                for x, y, k in zip(a[once].tolist(), numbers[b[once]].tolist(), (place - start[b])[once].tolist(), strict=True):
                    if texts[y].startswith(texts[x], k) or texts[x] in texts[y]:
                        inner.append(x)
                        outer.append(y)
    known = np.array([i for i, x in enumerate(texts) if x is not None], np.int64)
    blank = [np.full(len(known), i) for i, x in enumerate(texts) if x == ""]
    a, b = np.concatenate([np.array(inner, np.int64), *blank]), np.concatenate([np.array(outer, np.int64), *[known] * len(blank)])
    pairs = np.unique(np.concatenate([a * len(texts) + b, b * len(texts) + a, known * len(texts) + known]))
    return np.searchsorted(pairs, np.arange(len(texts) + 1) * len(texts)), pairs % max(len(texts), 1)


def merge_profile(items: DataFrame, increments: DataFrame, as_of: str) -> DataFrame:
    """Profile items after increments, taken one by one in order.

    ``items``: category, pos, content, updated_at, stale; ``increments``: seq,
    category, content. An increment replaces the first item of its category that
    contains it or is contained in it, and is appended otherwise; empty ones are
    skipped, and a missing category is "other". The fold is sequential by
    definition, so a category is one group and must fit one task's memory; which
    texts contain each other is looked up beforehand by hashes, not by comparing all pairs.
    """
    old = items.select("category", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("seq"), "content", "updated_at", "stale")
    new = increments.where(F.coalesce("content", F.lit("")) != "").select(F.coalesce("category", F.lit(OTHER)).alias("category"), F.lit(1).alias("kind"), F.col("seq").cast("long"), "content", F.lit(as_of).alias("updated_at"), F.lit(False).alias("stale"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["kind", "seq"], kind="stable")
        number = {x: i for i, x in enumerate(dict.fromkeys(part["content"]))}
        starts, others = related(list(number))
        lead = np.full(len(number), len(part))  # the first place that holds a text now
        holds: list[list[int]] = [[] for _ in number]  # a heap of places for each text; a place may hold another by now
        kept: list[list] = []
        for row in part.itertuples(index=False):
            me, hit = number[row.content], len(kept)
            if row.kind:
                hit = min(hit, int(lead[others[starts[me] : starts[me + 1]]].min()))
            if hit == len(kept):
                kept.append([row.content, row.updated_at, bool(row.stale), me])
                heapq.heappush(holds[me], hit)
            else:
                was = kept[hit][3]
                kept[hit] = [row.content, row.updated_at, False, me]
                if was != me:
                    heapq.heappush(holds[me], hit)
                    while holds[was] and kept[holds[was][0]][3] != was:
                        heapq.heappop(holds[was])
                    lead[was] = holds[was][0] if holds[was] else len(part)
            lead[me] = min(lead[me], hit)
        return pd.DataFrame({"category": part["category"].iloc[0], "pos": range(len(kept)), "content": [k[0] for k in kept], "updated_at": [k[1] for k in kept], "stale": [k[2] for k in kept]})

    return old.unionByName(new).groupBy("category").applyInPandas(fold, "category string, pos long, content string, updated_at string, stale boolean")


def merge_topics(entries: DataFrame, increments: DataFrame, as_of: str, similar: float = SIMILAR, cap: int = MOST_ENTRIES, days: int = EXPIRY_DAYS) -> DataFrame:
    """Topic entries after one increment a topic.

    ``entries``: slug, pos, title, task, date; ``increments``: slug, title, task.
    The first entry with a title similarity over ``similar`` takes the new task and
    date; without one the increment comes first. Then a topic keeps its first
    ``cap`` entries, and of those the ones younger than ``days``.
    """
    new = increments.select(F.col("slug").alias("__slug"), F.col("title").alias("__title"), F.col("task").alias("__task"))
    pair = entries.join(new, F.col("slug") == F.col("__slug"), "left")
    like = F.coalesce(char_jaccard("__title", "title") > similar, F.lit(False))
    hit = pair.where(like).groupBy("slug").agg(F.min("pos").alias("__hit"))
    rows = pair.join(hit, "slug", "left")
    mine = F.col("pos").eqNullSafe(F.col("__hit"))
    rows = rows.select("slug", "pos", "title", F.when(mine, F.coalesce("__task", "task")).otherwise(F.col("task")).alias("task"), F.when(mine, F.lit(as_of)).otherwise(F.col("date")).alias("date"))
    fresh = increments.join(hit, "slug", "left_anti").select("slug", F.lit(-1).cast("long").alias("pos"), "title", "task", F.lit(as_of).alias("date"))
    return expire(newest(rows.withColumn("pos", F.col("pos").cast("long")).unionByName(fresh), cap), as_of, days)


def newest(entries: DataFrame, cap: int = MOST_ENTRIES) -> DataFrame:
    """The first ``cap`` entries of each topic, numbered anew."""
    w = Window.partitionBy("slug").orderBy("pos", "title")
    first = entries.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap)  # a rank limit, pushed before the shuffle
    return first.withColumn("pos", F.col("__n").cast("long") - 1).drop("__n")


def expire(entries: DataFrame, as_of: str, days: int = EXPIRY_DAYS) -> DataFrame:
    return entries.where(days_since("date", as_of, 999.0) < days)


def upsert_index(index: DataFrame, changed: DataFrame) -> DataFrame:
    """Index rows by slug: replaced in place, or appended; the vector is reset.

    Both: slug, pos, title, keywords, entry_count. New slugs follow in slug order.
    """
    new = changed.select(F.col("slug").alias("__slug"), *(F.col(c).alias(f"__{c}") for c in ("title", "keywords", "entry_count")))
    both = index.join(new, F.col("slug") == F.col("__slug"), "full_outer")
    rows = both.select(F.coalesce("slug", "__slug").alias("slug"), F.col("pos"), *(F.when(F.col("__slug").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "keywords", "entry_count")))
    return rows.withColumn("embedding", F.lit(None).cast("array<float>"))


def merge_keywords(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def consolidate(staged: DataFrame) -> DataFrame:
    """The last staged increment of each session."""
    return staged.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in staged.columns if c != "session_id"]), "seq").alias("x")).select("session_id", "x.*")


EXTRACTED = "session_id string, kind string, category string, content string, slug string, title string, task string, approach string, lessons string, keywords array<string>"


def extract(transcripts: DataFrame, preferences, experience) -> DataFrame:
    """What a session teaches: rows of kind "preference" and at most one of kind "topic".

    ``transcripts``: session_id, text. Both callables are models, given a batch of
    texts and answering in prose with a JSON object; an answer of None, without JSON or
    of another shape gives nothing.
    """
    names = [c.split()[0] for c in EXTRACTED.split(", ")]
    blank = dict.fromkeys(names)

    def run(batches):
        for part in batches:
            texts, rows = part["text"].fillna("").tolist(), []
            for key, liked, learned in zip(part["session_id"], map(_object, preferences(texts)), map(_object, experience(texts)), strict=True):
                found = liked.get("preferences")
                for p in found if isinstance(found, list) else ():
                    if isinstance(p, dict) and p.get("content"):
                        rows.append(blank | {"session_id": key, "kind": "preference", "category": p.get("category") or OTHER, "content": str(p["content"])})
                told = learned.get("memory")
                if learned.get("has_memory") and isinstance(told, dict):
                    rows.append(blank | {"session_id": key, "kind": "topic", "slug": told.get("topic_slug"), **{k: told.get(k) for k in ("title", "task", "approach", "lessons", "keywords")}})
            yield pd.DataFrame(rows, columns=names).astype(object)

    return transcripts.select(F.col("session_id").cast("string").alias("session_id"), "text").mapInPandas(run, EXTRACTED)


def _object(answer: str | None) -> dict:
    found = balanced(answer) if answer else None
    got = json.loads(found) if found else {}
    return got if isinstance(got, dict) else {}


def profile_block(items: DataFrame, limit: int = 1000) -> DataFrame:
    """A profile as text lines within a budget of characters.

    ``items``: user, cat_pos, category, pos, content, stale. A category's items stop
    at the first that no longer fits; later categories may still fit, until the
    budget is passed. A user's profile is short, so it is folded as one array.
    """
    one = F.struct("cat_pos", "category", "pos", F.concat(F.lit("- "), F.when(F.col("stale"), F.lit("⚠️ [可能已过时] ")).otherwise(F.lit("")), F.col("content")).alias("line"))
    rows = items.groupBy("user").agg(F.array_sort(F.collect_list(one)).alias("xs"))
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).cast("long").alias("full"), F.array().cast("array<string>").alias("lines"), F.lit(-1).cast("long").alias("cat"))

    def step(a, x):
        head = x["cat_pos"] != a["cat"]
        over = head & (a["used"] > limit)
        shut = (a["full"] == x["cat_pos"]) | over
        fits = ~shut & (a["used"] + F.length(x["line"]) <= limit)
        titled = F.when(head & ~over, F.array_append(a["lines"], F.concat(F.lit("## "), x["category"]))).otherwise(a["lines"])
        lines = F.when(fits, F.array_append(titled, x["line"])).when(shut, titled).otherwise(F.array_append(titled, F.lit("- (...更多偏好已省略)")))
        return F.struct((a["used"] + F.when(fits, F.length(x["line"])).otherwise(0)).alias("used"), F.when(fits, a["full"]).otherwise(x["cat_pos"].cast("long")).alias("full"), lines.alias("lines"), x["cat_pos"].cast("long").alias("cat"))

    return rows.select("user", F.array_join(F.aggregate("xs", start, step)["lines"], "\n").alias("block"))

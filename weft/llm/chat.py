"""Operator 9: chat formatting with a hidden Markov model.

A transcript is a sequence of turns whose speakers are to be recovered; a row may
hold one turn or a stretch of transcript with several, each opened by a speaker
marker at the start of a line ("User:", "### Assistant", "<|system|>", ...). The
observations are the segments between such markers, the states are the roles. A
segment emits features: the role its marker names, how long it is, how many lines
it has, whether it asks, and whether it opens its transcript. Viterbi finds the
likeliest roles; then every turn is rendered in one canonical form. A marker that
names the role found goes; one that names another is text ("Answer: 4" inside a
user's turn), and a segment with its forerunner's role continues its turn.

Probabilities are counted on rows whose role is given. Emissions of markers start
from ``PRIOR`` imagined rows a role that mostly (``TRUST``) carry its own marker,
so markers work in unmarked corpora as well and counts can overrule them; all
other counts start at one. Steps between rows are counted, steps inside a row,
which no row labels, are even.

Rows are sorted by transcript, turn number and a hash of the text over all tasks
and cut into blocks of ``BLOCK`` rows or ``BLOCK_BYTES``, so neither a long
transcript nor equal numbers meet in one task. A block's best scores from each
entry role to each exit role form a matrix. The matrices of a transcript chain up
in two levels (within a partition, then over partitions), and each block traces
its own path between the roles that the chain gives it.

Defined edge cases: a null text is empty; turns without a number come first,
turns with equal numbers are ordered by a hash of the text; null transcript ids
form one transcript, apart from every other id; repeated rows each get a row; a
very long text is one row of a block of its own; an empty table gives an empty
result; other columns are ignored; without any labelled turn the roles are
assistant, system and user with even probabilities, so markers decide.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

BLOCK, BLOCK_BYTES, TRUST, PRIOR = 256, 4 << 20, 0.999, 20.0
# Names that speaker markers use.
SPEAKERS = {"system": "system sys instruction instructions", "user": "user human customer question q prompt you me", "assistant": "assistant bot ai model answer a agent gpt response", "tool": "tool function"}
NAMES = {n: role for role, names in SPEAKERS.items() for n in names.split()}
# No piece gives back what it has taken, and only the first line's blanks may span lines, so a text is read once.
_NAMED = r"(?:<\|\s*+(?:im_start\|>)?+\s*+([A-Za-z]++)\s*+(?:\|>)?+|\[\s*+([A-Za-z]++)\s*+\]\s*+:?+|#{1,6}+\s*+([A-Za-z]++)(?:\s*+:[ \t]*+(?:\n|$)|[^\S\n]*+(?:\n|$))|(?:\*++\s*+)?+([A-Za-z]++)\s*+\**+\s*+(?:\(\d++\))?+\s*+:(?!/))"
MARKER = re.compile(r"\s*+" + _NAMED)
OPENING = re.compile(r"(?<=\n)[^\S\n]*+" + _NAMED)


def marker(text: str) -> tuple[str | None, int]:
    """The role that an opening marker names, and where the text after it starts."""
    m = MARKER.match(text)
    role = NAMES.get(next(g for g in m.groups() if g).lower()) if m else None
    return (role, m.end()) if role else (None, 0)


def segments(text: str, roles) -> list[str]:
    """The text cut before every line that opens with a marker of one of ``roles``."""
    blank = len(text) - len(text.lstrip())
    cuts = [m.start() for m in OPENING.finditer(text) if m.start() > blank and NAMES.get(next(g for g in m.groups() if g).lower()) in roles]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def look(text: str | None, first: bool) -> list[str]:
    """Features of one segment."""
    text = text or ""
    role, at = marker(text)
    body = text[at:].strip()
    n = len(body.split())
    return [f"marker={role}", f"words={0 if n == 0 else int(np.log2(n)) + 1}", f"lines={min(body.count(chr(10)), 4)}", f"asks={body.endswith('?')}", f"first={first}"]


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray
    step: np.ndarray  # from x to
    emit: dict[str, np.ndarray]
    rest: np.ndarray

    def score(self, names: list[str]) -> np.ndarray:
        return sum((self.emit.get(n, self.rest) for n in names), np.zeros(len(self.roles)))

    def observe(self, texts: list[str | None], opens: bool):
        """Emissions of all segments of some rows in order, the steps between them, and each row's number of segments."""
        parts = [segments(t or "", self.roles) for t in texts]
        emit = [self.score(look(p, opens and i == j == 0)) for i, ps in enumerate(parts) for j, p in enumerate(ps)]
        even = np.full_like(self.step, -np.log(len(self.roles)))
        steps = [self.step if j == 0 else even for ps in parts for j in range(len(ps))]
        return np.stack(emit), np.stack(steps)[1:], [len(ps) for ps in parts]


def chain(enter: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best scores from the rows of ``enter`` to each role at the stretch's end."""
    m = enter + emit[0]
    for s, e in zip(np.broadcast_to(step, (len(emit) - 1, *step.shape[-2:])), emit[1:], strict=True):
        m = (m[:, :, None] + s).max(axis=1) + e
    return m


def trace(enter: np.ndarray, step: np.ndarray, emit: np.ndarray, last: int | None = None) -> list[int]:
    """Likeliest roles of a stretch; ``enter`` scores its first role, ``last`` fixes its final one."""
    v, back = enter + emit[0], []
    for s, e in zip(np.broadcast_to(step, (len(emit) - 1, *step.shape[-2:])), emit[1:], strict=True):
        through = v[:, None] + s
        back.append(through.argmax(axis=0))
        v = through.max(axis=0) + e
    path = [int(v.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def link(matrices: list[np.ndarray], entry: int, leave: int) -> tuple[list[int], list[int]]:
    """Entry and exit role of each of a row of stretches; ``entry`` -1: any start (its rows are alike), ``leave`` -1: the best."""
    seen = [matrices[0][max(entry, 0)]]
    for m in matrices[1:]:
        seen.append((seen[-1][:, None] + m).max(axis=0))
    out = [int(seen[-1].argmax()) if leave < 0 else leave]
    for b in range(len(matrices) - 1, 0, -1):
        out.append(int((seen[b - 1] + matrices[b][:, out[-1]]).argmax()))
    out = out[::-1]
    return [entry, *out[:-1]], out


def render(role: str, text: str | None) -> str:
    """One turn in canonical form, without the speaker marker that names its role."""
    return f"<|{role}|>\n{_body(role, text or '')}\n<|end|>"


def _body(role: str, text: str) -> str:
    named, at = marker(text)
    return text[at if named == role else 0 :].strip()


def transcript(roles: list[str], parts: list[str]) -> str:
    """All turns of one row; segments of one role in a row are one turn."""
    turns: list[tuple[str, list[str]]] = []
    for role, part in zip(roles, parts, strict=True):
        if not turns or turns[-1][0] != role:
            turns.append((role, []))
        turns[-1][1].append(_body(role, part))
    return "\n".join(f"<|{role}|>\n" + "\n".join(said) + "\n<|end|>" for role, said in turns)


def blocks(rows: DataFrame) -> DataFrame:
    """One row a block: conv_id, block (grows with the order of turns), turn, text and role arrays."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "text", "role" if "role" in rows.columns else F.lit(None).cast("string").alias("role"))
    order = ["conv_id", "turn", "hash", "row"]
    dealt = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        base, n, held, size = TaskContext.get().partitionId() << 32, 0, None, 0

        def out():
            conv, turns = held
            cols = [list(c) for c in zip(*turns, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([base + n], pa.int64()), pa.array([cols[0]], pa.list_(pa.int64())), pa.array([cols[1]], pa.list_(pa.string())), pa.array([cols[2]], pa.list_(pa.string()))], ["conv_id", "block", "turn", "text", "role"])

        for batch in slices(batches):
            kind = batch.schema.field("conv_id").type
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if held and (held[0] != conv or len(held[1]) >= BLOCK or size >= BLOCK_BYTES):
                    yield out()
                    n, held, size = n + 1, None, 0
                held = held or (conv, [])
                held[1].append(turn)
                size += len(turn[1] or "")
        if held:
            yield out()

    return materialize(dealt.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, block long, turn array<long>, text array<string>, role array<string>"), "turns")


def _ends(cut: DataFrame) -> DataFrame:
    """The blocks with opens (the first of its transcript) and single (the only one)."""
    ends = cut.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).withColumnRenamed("conv_id", "c")
    rows = cut.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return rows.withColumns({"opens": F.col("block") == F.col("lo"), "single": F.col("lo") == F.col("hi")}).drop("lo", "hi")


def train(rows: DataFrame) -> Model:
    """Count starts, steps and features over all rows with a role."""
    return _train(blocks(rows.where("role is not null")))


def _train(cut: DataFrame) -> Model:
    def run(batches):
        n = Counter()
        for batch in batches:
            for texts, roles, opens in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for i, (text, role) in enumerate(zip(texts, roles, strict=True)):
                    if role is None:
                        continue
                    first = opens and i == 0
                    n.update((role, name) for name in look(segments(text or "", NAMES.values())[0], first))
                    n[role, "turn"] += 1
                    n[role, "opens"] += first
                    if i and roles[i - 1] is not None:
                        n[roles[i - 1], "to " + role] += 1
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())], ["role", "name", "n"])

    ended = _ends(cut)
    counts = ended.select("text", "role", "opens").mapInArrow(run, "role string, name string, n long")
    after = Window.partitionBy("conv_id").orderBy("block")  # one row a block, of long transcripts only
    across = ended.where("not single").select("conv_id", "block", F.element_at("role", -1).alias("role"), F.element_at("role", 1).alias("to"))
    across = across.withColumn("to", F.lead("to").over(after)).where("role is not null and to is not null")
    counts = counts.union(across.groupBy("role", F.concat(F.lit("to "), "to").alias("name")).agg(F.count("*").alias("n")))
    got = {(r["role"], r["name"]): r["n"] for r in counts.groupBy("role", "name").agg(F.sum("n").alias("n")).collect()}  # roles x features
    roles = sorted({r for r, _ in got}) or ["assistant", "system", "user"]
    n = len(roles)
    turns = np.array([float(got.get((r, "turn"), 0)) for r in roles])
    start = np.array([1.0 + got.get((r, "opens"), 0) for r in roles])
    step = np.array([[1.0 + got.get((a, "to " + b), 0) for b in roles] for a in roles])
    total = turns + 2
    kinds = {name for _, name in got if "=" in name and not name.startswith("marker=")}
    emit = {name: np.log(np.array([1.0 + got.get((r, name), 0) for r in roles]) / total) for name in kinds}
    for name in [None, *SPEAKERS]:  # half of the imagined rows carry a marker
        own = np.array([0.5 if name is None else 0.5 * TRUST if r == name else 0.5 * (1 - TRUST) / len(SPEAKERS) for r in roles])
        emit[f"marker={name}"] = np.log((np.array([float(got.get((r, f"marker={name}"), 0)) for r in roles]) + PRIOR * own) / (turns + PRIOR))
    return Model(roles, np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), emit, np.log(1 / total))


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, role_pred (of the row's first turn) and rendered for every row; also role where given."""
    out = _parse(blocks(rows), model)
    return out if "role" in rows.columns else out.drop("role")


def _parse(cut: DataFrame, model: Model) -> DataFrame:
    ended = _ends(cut)
    conv = dict(cut.dtypes)["conv_id"]
    n = len(model.roles)

    def matrices(batches):
        for batch in batches:
            ms = []
            for texts, opens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                emit, step, _ = model.observe(texts, opens)
                ms.append(chain(np.tile(model.start, (n, 1)) if opens else model.step, step, emit).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ms, pa.list_(pa.float64()))], ["conv_id", "block", "m"])

    def squared(part):
        return [np.asarray(m).reshape(n, n) for m in part["m"]]

    def folded(part: pd.DataFrame) -> pd.DataFrame:
        """One matrix for the blocks of a transcript in one partition."""
        part = part.sort_values("block", ignore_index=True)
        whole, *more = squared(part)
        for m in more:
            whole = (whole[:, :, None] + m).max(axis=1)
        return part[["conv_id", "part"]].head(1).assign(m=[whole.ravel().tolist()])

    def linked(key: str):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(key, ignore_index=True)
            entry, leave = link(squared(part), int(part["entry"].iloc[0]), int(part["leave"].iloc[0]))
            return part[["conv_id", key]].assign(entry=entry, leave=leave)

        return run

    def traced(batches):
        for batch in batches:
            for c, turns, texts, roles, opens, entry, leave in zip(*([col.slice(i, 1) for i in range(batch.num_rows)] if k == 0 else col.to_pylist() for k, col in enumerate(batch.columns)), strict=True):
                emit, step, sizes = model.observe(texts, opens)
                path = [model.roles[i] for i in trace(model.start if opens else model.step[entry], step, emit, None if leave is None else leave)]
                at, first, said = 0, [], []
                for text, size in zip(texts, sizes, strict=True):
                    first.append(path[at])
                    said.append(transcript(path[at : at + size], segments(text or "", model.roles)))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c] * len(turns)), pa.array(turns, pa.int64()), pa.array(roles, pa.string()), pa.array(first, pa.string()), pa.array(said, pa.string())], ["conv_id", "turn", "role", "role_pred", "rendered"])

    # Conversation ids pass through pandas below, where nulls would make floats of them.
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    each = ended.where("not single").select("conv_id", "block", "text", "opens").mapInArrow(matrices, f"conv_id {conv}, block long, m array<double>")
    each = materialize(each.select(name.alias("conv_id"), "block", F.shiftright("block", 32).alias("part"), "m"), "chain")
    parts = each.groupBy("conv_id", "part").applyInPandas(folded, "conv_id string, part long, m array<double>").withColumns({"entry": F.lit(-1), "leave": F.lit(-1)})
    parts = parts.groupBy("conv_id").applyInPandas(linked("part"), "conv_id string, part long, entry int, leave int")
    links = each.join(parts, ["conv_id", "part"]).groupBy("conv_id", "part").applyInPandas(linked("block"), "conv_id string, block long, entry int, leave int")
    links = links.select(F.col("block").alias("b"), "entry", "leave")
    rows = ended.join(links, F.col("block") == F.col("b"), "left").select("conv_id", "turn", "text", "role", "opens", "entry", "leave")
    return rows.mapInArrow(traced, f"conv_id {conv}, turn long, role string, role_pred string, rendered string")


def op9(rows: DataFrame) -> DataFrame:
    cut = blocks(rows)
    return _parse(cut, _train(cut)).select("conv_id", "turn", "role_pred", "rendered")

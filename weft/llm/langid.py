"""Operator 8: language identification.

Method: every text becomes the average of hashed subword embeddings (byte
n-grams of the lower-cased text), a linear softmax reads the average, both are
trained together by stochastic gradient descent in numpy, and a temperature
fitted on held-back rows calibrates the probabilities. Because the softmax
layer is linear, embedding and output weights fold into one table of logits per
bucket, and prediction is a table lookup over the whole text.

Training reads a bounded sample: ``per_lang`` labelled documents of each language,
those with the smallest hash of their id. Counts of the languages give a bound on
the hash that only a few times as many ids pass, so the ranking never meets a whole
language in one task. Prediction covers every row.

Defined edge cases: a null text or one without a letter (Unicode category L) gives
``und`` and score 0; with no labelled rows at all, every row gives ``und``;
repeated rows each get their own result, while training takes one text an id (the
smallest); of equal scores the language that sorts first wins; a very long text is
read in pieces of ``PIECE`` bytes; an empty table gives an empty result; other
columns are ignored, or carried through by the stage, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, fresh, slices

BITS, ORDERS, DIM = 15, (2, 3, 4), 12
PER_LANG, EPOCHS, STEPS, RATE, BATCH = 500, 10, 500, 0.4, 32
PIECE = 1 << 18
MAYBE_LETTER = re.compile(r"[^\W\d_]")
_K, _M = np.uint32(0x01000193), np.uint32(0x9E3779B1)

#: ASCII bytes that are not letters read as a space; all other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def lettered(text: str) -> bool:
    """Whether the text has a letter; signs like ² or Ⅷ are none."""
    return any(unicodedata.category(m.group())[0] == "L" for m in MAYBE_LETTER.finditer(text))


def pieces(raw: np.ndarray):
    """Stretches of at most ``PIECE`` bytes; together their n-grams are those of the whole, up to the cuts."""
    for at in range(0, max(len(raw), 1), PIECE):
        yield raw[at : at + PIECE]


def buckets(raw: np.ndarray) -> np.ndarray:
    """Bucket numbers of all byte n-grams of one lower-cased text."""
    x = np.empty(len(raw) + 2, np.uint32)
    x[0] = x[-1] = 32
    x[1:-1] = _FOLD[raw]
    out, h = [], x
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * _K + x[n - 1 :]
        if n in ORDERS:
            out.append(((h ^ np.uint32(n)) * _M) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def _texts(batch: pa.RecordBatch):
    """Pairs of the text (or None) and its lower-cased bytes."""
    col = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
    low = pc.utf8_lower(col).cast(pa.binary())
    for text, raw in zip(col.to_pylist(), low.to_pylist(), strict=True):
        yield text, np.frombuffer(raw or b"", np.uint8)


def _histograms(batches):
    for batch in slices(batches):
        keys, n = [], []
        for text, raw in _texts(batch):
            if text is None or not lettered(text):
                keys.append(b"")
                n.append(b"")
                continue
            got = sum(np.bincount(buckets(x), minlength=1 << BITS) for x in pieces(raw))
            nz = np.flatnonzero(got)
            keys.append(nz.astype("<u2").tobytes())
            n.append((got[nz] / got.sum()).astype("<f2").tobytes())
        at = batch.column(batch.schema.get_field_index("doc_id"))
        yield pa.RecordBatch.from_arrays(
            [at, batch.column(batch.schema.get_field_index("lang")), pa.array(keys, pa.binary()), pa.array(n, pa.binary())],
            ["doc_id", "lang", "k", "v"],
        )


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    reject: float

    def predict(self, raw: np.ndarray) -> tuple[int, float]:
        total, n = np.zeros(len(self.langs)), 0
        for x in pieces(raw):
            got = buckets(x)
            total += self.logits[got].sum(axis=0, dtype=np.float64)
            n += len(got)
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return best, float(p[best])


def _sums(rows, emb):
    """The averaged embedding of each sparse row."""
    lens = [len(k) for k, _ in rows]
    k = np.concatenate([r[0] for r in rows])
    v = np.concatenate([r[1] for r in rows])
    of = np.repeat(np.arange(len(rows)), lens)
    hidden = np.add.reduceat(emb[k] * v[:, None], np.concatenate([[0], np.cumsum(lens)[:-1]]))
    return hidden, k, v, of


def fit(rows: list[tuple], seed: int = 7) -> Model | None:
    """``rows``: (lang, bucket array, weights that sum to 1), in a fixed order."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    y = np.array([langs.index(r[0]) for r in rows])
    x = [(np.asarray(r[1], np.int64), np.asarray(r[2], np.float32)) for r in rows]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cal, train = (order[: len(x) // 5], order[len(x) // 5 :]) if len(x) >= 50 else (order, order)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    # A row touches each bucket with a weight near 1/length, so the embedding step is scaled up.
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(train)))  # small samples go round more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        todo = rng.permutation(train)
        for i in range(0, len(todo), BATCH):
            part = todo[i : i + BATCH]
            hidden, k, v, of = _sums([x[j] for j in part], emb)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = (p @ out.T).astype(np.float32)
            out -= rate * hidden.T @ p
            bias -= rate * p.sum(axis=0)
            np.add.at(emb, k, -(rate * 100) * v[:, None] * back[of])
    hidden = _sums([x[j] for j in cal], emb)[0]
    z, want = (hidden @ out + bias).astype(np.float64), y[cal]

    def loss(t):
        s = z / t
        return float(np.mean(np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), want]))

    temperature = min((2.0**e for e in np.arange(-1, 4.01, 0.25)), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == want]
    # Rejects below half, and well below what all but one in a thousand right calibration rows reach.
    reject = min(0.5, 0.8 * float(np.quantile(right, 0.001))) if len(right) else 0.0
    return Model(langs, (emb @ out).astype(np.float32), bias, float(temperature), reject)


def some_ids(rows: DataFrame, per_lang: int) -> DataFrame:
    """doc_id and lang of the ``per_lang`` ids of each language with the smallest hashes."""
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    key = F.xxhash64("doc_id")
    ids = rows.select("doc_id", "lang").where(key <= _bound(held, per_lang)).distinct()
    first = Window.partitionBy("lang").orderBy(key, "doc_id")
    return ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang).select("doc_id", "lang")


def _bound(held: dict[str, int], per_lang: int) -> Column:
    """A hash that about 2 ``per_lang`` + 200 rows of the language stay below."""
    bound = F.lit((1 << 63) - 1)
    for lang, n in sorted(held.items()):
        if n > 2 * per_lang + 200:
            bound = F.when(F.col("lang") == lang, F.lit(int((2 * per_lang + 200) / n * 2.0**64) - (1 << 63))).otherwise(bound)
    return bound


def train(docs: DataFrame, usable=None, per_lang: int = PER_LANG) -> Model | None:
    """Fit on at most ``per_lang`` labelled documents of each language, one text an id."""
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and doc_id is not null and text is not null")
    rows = rows.where(usable) if usable is not None else rows
    some = some_ids(rows, per_lang).select("doc_id").distinct()
    got = rows.join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("s"))  # bounded: per_lang ids a language
    got = got.select("doc_id", "s.lang", "s.text").mapInArrow(_histograms, "doc_id long, lang string, k binary, v binary").toArrow()  # a few KB a row
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    lang, k, v = (got[c].to_pylist() for c in ("lang", "k", "v"))
    return fit([(a, np.frombuffer(b, "<u2"), np.frombuffer(c, "<f2")) for a, b, c in zip(lang, k, v, strict=True)])


def _predicted(docs: DataFrame, model: Model | None, extra: list[str] = ()) -> DataFrame:
    """doc_id and ``extra`` columns, with the language, the score and whether it is rejected."""
    keep = ["doc_id", *extra]
    names = [fresh(docs, c) for c in ("lang_pred", "lang_score", "lang_rejected")]

    def run(batches):
        for batch in slices(batches):
            langs, scores = [], []
            for text, raw in _texts(batch):
                if text is None or model is None or not lettered(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best, score = model.predict(raw)
                langs.append(model.langs[best])
                scores.append(score)
            bad = [lang == "und" or score < model.reject for lang, score in zip(langs, scores, strict=True)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())], [*keep, *names])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", {} string, {} double, {} boolean".format(*names)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row."""
    return _predicted(docs, model).toDF("doc_id", "lang_pred", "score", "rejected")


def op8(docs: DataFrame) -> DataFrame:
    fold = crc_fold(F.col("doc_id"), 3)
    model = train(docs, fold != 1)
    return predict(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go."""
    model = train(docs, crc_fold(F.col("doc_id"), 3) != 1)
    extra = [c for c in docs.columns if c != "doc_id"]
    return _predicted(docs, model, extra).where(~F.col(fresh(docs, "lang_rejected"))).select(*docs.columns)

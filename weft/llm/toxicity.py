"""Operator 6: toxicity by gradient-boosted trees over dense features.

Features of a whole text: densities of a fixed lexicon of insults and of words
that mark toxic training rows, how close such words stand to second-person
words, shares of capitals and of words in capitals, punctuation rates, and rates
of obfuscated words (digits or signs inside, letters drawn out) with those that
turn into lexicon words once undone. Trees are fitted in numpy on binned
features with the logistic loss; isotonic regression on held-back rows turns
their sum into a probability.

Training reads at most ``TRAIN`` labelled documents (smallest hash of the id), and
only of those that the caller allows. A quarter of them, by another hash of the
id, calibrates and takes no part in choosing words or growing trees. Every
document is scored.

Defined edge cases: a null or empty text is scored on its all-zero features;
without labelled rows of both kinds the score is the share of toxic rows (0 if
none); repeated rows each get a result, while training takes one text an id (the
smallest) and the worse of two labels; rows with equal features have equal scores,
and a score of exactly 0.5 counts as toxic; a very long text is one row of a batch
of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, crc_fold, materialize, slices

TRAIN, TREES, DEPTH, RATE, BINS = 12_000, 100, 3, 0.15, 32
LEARNED, LEAST_ROWS, LEAST_SHARE, LEAST_ODDS, NEAR = 200, 4, 0.005, 4.0, 5

# Insults and second-person words of four languages.
INSULTS = """
idiot idiots moron morons imbecile imbeciles stupid dumb fool fools clown clowns loser losers scum trash garbage filth
vermin worthless pathetic disgusting useless ugly retard retarded dumbass jackass bastard bitch asshole crap shit fuck
fucking damn hell kill die hate hateful creep pig pigs rat rats coward cowards liar liars brainless braindead psycho
freak lunatic degenerate parasite parasites subhuman
dumm dummkopf trottel vollidiot depp arsch arschloch schwein abschaum versager hurensohn wichser scheisse schlampe
feigling missgeburt wertlos erbärmlich ekelhaft
idiote imbécile crétin connard connasse salaud salope merde pute abruti débile ordure vermine minable pourriture raclure
lâche dégoûtant bouffon
idiota imbécil estúpido estúpida tonto tonta pendejo cabrón puta puto mierda basura escoria inútil asqueroso payaso
cobarde gilipollas
"""
SECOND = "you your yours yourself youre ur u du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
LEET = bytes.maketrans(b"013457@$!|", b"oieastasii")

INSULT = frozenset(w.encode() for w in INSULTS.split())
SECOND_PERSON = frozenset(w.encode() for w in SECOND.split())
PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum() and c > 32)
_BLANK = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
#: A run with a sign in it, from its beginning, and where in it the masked word begins; every run is read once.
RUN = re.compile(rb"(?<![a-z0-9@$!*|._-])[a-z]*+[0-9@$!*|._-][a-z0-9@$!*|._-]*+")
BEGIN = re.compile(rb"(?<![0-9@$!|])[0-9@$!|]++[a-z](?!\Z)|(?<![a-z])[a-z]++[0-9@$!*|._-]")
SIGNS = b"0123456789@$!*|._-"
DRAWN = re.compile(rb"([a-z])\1\1+")
_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
NAMES = ["insults", "n_insults", "learned", "n_learned", "near_second", "second", "capitals", "caps_words", "exclaim", "question", "punct", "digits", "masked", "masked_hits", "drawn", "length", "word_length", "distinct"]


def plain_words(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_BLANK).split()


def masked_words(low: bytes) -> list[bytes]:
    """Words of letters with signs among them: from the first letter or sign that may stand for one, to the last letter."""
    runs = (m.group().rstrip(SIGNS) for m in RUN.finditer(low))
    return [run[at.start() :] for run in runs if (at := BEGIN.search(run))]


_BY_LENGTH = {n: [w for w in INSULT if len(w) == n] for n in {len(w) for w in INSULT}}


def unmasked(word: bytes, marks) -> bool:
    """Whether a masked word stands for an insult, or a word of ``marks``; a star stands for any letter."""
    if b"*" in word:
        return any(all(a == b or a == 42 and 97 <= b <= 122 for a, b in zip(word, w, strict=True)) for w in _BY_LENGTH.get(len(word), ()))
    plain = re.sub(rb"[._-]", b"", word).translate(LEET)
    return plain in marks or plain in INSULT


def features(raw: bytes, learned: frozenset) -> list[float]:
    if not raw:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, low = plain_words(raw), raw.lower()
    n, size = max(len(words), 1), len(raw)
    distinct = set(words)
    marks = (INSULT | learned) & distinct
    hits = [i for i, w in enumerate(words) if w in marks] if marks else []
    insults = sum(words[i] in INSULT for i in hits)
    marked = sum(words[i] in learned for i in hits)
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    second = sum(w in SECOND_PERSON for w in words) if SECOND_PERSON & distinct else 0
    masked = masked_words(low)
    undone = sum(n for m, n in Counter(masked).items() if unmasked(m, marks))
    drawn = [w for w in distinct if DRAWN.search(w)]
    undone += sum(DRAWN.sub(rb"\1", w) in INSULT for w in drawn)
    upper, lower = int(count[_UPPER].sum()), int(count[_LOWER].sum())
    loud = len(re.findall(rb"\b[A-Z]{3,}\b", raw))
    punct = int(count[list(PUNCTUATION)].sum())
    return [insults / n, float(insults), marked / n, float(marked), near / max(len(hits), 1), second / n, upper / max(upper + lower, 1), loud / n, int(count[33]) / size, int(count[63]) / size, punct / size, int(count[48:58].sum()) / size, len(masked) / n, float(undone), len(drawn) / n, float(np.log1p(n)), sum(map(len, distinct)) / max(len(distinct), 1), len(distinct) / n]


@dataclass
class Model:
    learned: frozenset
    edges: np.ndarray  # feature x (BINS - 1)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, bin, leaf values
    start: float
    knots: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _margin(_binned(x, self.edges), self.trees, self.start)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), self.knots, self.values)


def _binned(x, edges):
    return np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1).astype(np.uint8)


def _margin(b, trees, start):
    out, rows = np.full(len(b), start), np.arange(len(b))
    for feature, cut, leaf in trees:
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        out += leaf[node - (2**DEPTH - 1)]
    return out


def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float = 1.0, least: float = 2.0):
    """One regression tree of fixed depth on gradients g and curvatures h."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, 255)
    node = np.zeros(len(b), np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        local = node - first
        sums = np.stack([[np.bincount(local * BINS + b[:, j], weights=w, minlength=width * BINS).reshape(width, BINS) for j in range(b.shape[1])] for w in (g, h)])
        gl, hl = np.cumsum(sums[0], axis=2), np.cumsum(sums[1], axis=2)  # feature x node x bin
        gt, ht = gl[:, :, -1:], hl[:, :, -1:]
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        gain[(hl < least) | (ht - hl < least)] = -1.0
        for k in range(width):
            j, c = np.unravel_index(gain[:, k].argmax(), gain[:, k].shape)
            if gain[j, k, c] > 1e-6:
                feature[first + k], cut[first + k] = j, c
        node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
    at = node - inner
    leaf = -np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + ridge)
    return feature, cut, leaf * RATE


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on m."""
    order = np.argsort(m, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first, last
    for a, t in zip(m[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(a), float(a)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v, w, _, last = blocks.pop()
            top = blocks[-1]
            top[0], top[1], top[3] = (top[0] * top[1] + v * w) / (top[1] + w), top[1] + w, last
    knots = [k for blk in blocks for k in ((blk[2], blk[0]), (blk[3], blk[0]))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def fit(x: np.ndarray, y: np.ndarray, learned: frozenset, held: np.ndarray) -> Model:
    """``held`` marks the rows that calibrate; if one part has rows of one kind only, all rows do both."""
    cal, use = np.flatnonzero(held), np.flatnonzero(~held)
    if len(np.unique(y[use])) < 2 or len(np.unique(y[cal])) < 2:
        cal = use = np.arange(len(y))
    edges = np.stack([np.quantile(x[use, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(x.shape[1])])
    b, t = _binned(x[use], edges), y[use]
    start = float(np.log((t.mean() + 1e-6) / (1 - t.mean() + 1e-6)))
    z, trees = np.full(len(t), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = grow(b, p - t, p * (1 - p))
        trees.append(tree)
        z = z + _margin(b, [tree], 0.0)
    m = _margin(_binned(x[cal], edges), trees, start)
    return Model(learned, edges, trees, start, *isotonic(m, y[cal].astype(float)))


def _count_words(batches):
    """Rows of a word: in how many toxic and in how many other training texts."""
    n, bad = Counter(), Counter()
    for batch in slices(batches):
        for raw, toxic in zip(blobs(batch), batch.column(1).to_pylist(), strict=True):
            (bad if toxic else n).update(set(plain_words(raw)))
    keys = sorted(n.keys() | bad.keys())
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([bad[w] for w in part], pa.int64()), pa.array([n[w] for w in part], pa.int64())], ["w", "bad", "good"])


def _featured(learned, keep):
    def run(batches):
        for batch in slices(batches):
            x = np.array([features(raw, learned) for raw in blobs(batch)], np.float32)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable=None, most: int = TRAIN) -> Model | float:
    rows = labels.where("doc_id is not null and toxic is not null")
    rows = (rows.where(usable) if usable is not None else rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # bounded by ``most``
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    got = materialize(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", "doc_id", held.alias("held")), "toxic")
    use = got.where("not held")
    total = use.agg(F.sum("toxic"), F.count("*")).first()
    n_bad, n_good = int(total[0] or 0), int(total[1]) - int(total[0] or 0)
    if not n_bad or not n_good:
        share = got.agg(F.avg("toxic")).first()[0] or 0.0
        if not 0 < share < 1:
            return float(share)
        learned = frozenset()  # both kinds only with the rows that calibrate: no words are learned
    else:
        counts = use.mapInArrow(_count_words, "w binary, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        odds = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("good") + 0.5) / (n_good + 1))
        top = counts.where((F.col("bad") >= max(LEAST_ROWS, LEAST_SHARE * n_bad)) & (odds >= LEAST_ODDS)).orderBy(odds.desc(), "w").limit(LEARNED).collect()
        learned = frozenset(bytes(r["w"]) for r in top)
    table = got.mapInArrow(_featured(learned, ["doc_id", "toxic", "held"]), "doc_id long, toxic int, held boolean, x binary").toArrow().sort_by([("doc_id", "ascending")])
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(float)
    return fit(x, table["toxic"].to_numpy(), learned, table["held"].to_numpy())


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for batch in slices(batches):
            if isinstance(model, float):
                got = np.full(batch.num_rows, model)
            else:
                got = model.score(np.array([features(raw, model.learned) for raw in blobs(batch)], np.float32).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(got, 0, 1))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, crc_fold(F.col("doc_id"), 5) != 0)
    held = (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Toxicity: a logistic classifier over words and parts of words, regularised by counterfactual identity swaps.

Features are the character sequences of 4 to 8 that occur in words (a space at either end marks the word's boundary), chosen by their association
with the label; a document has a feature or not, so a few toxic words weigh as much in a long text. Every labelled text gives counterfactuals: its
identity terms name the next groups instead; a text without any gets a neutral mention placed in one of its sentences, which then names another
group. The loss has the squared change of the score between both, and between a text and the same one with the mention,
so weights that tell groups apart, or mentions from none, go to zero and neutral mentions of a group are left alone.

Bound: features and weights are learnt from at most MAX_LABELLED labelled rows, the first by a hash of doc_id; the rows for learning are
given by the caller; of rows that share a labelled doc_id one text is learnt from, the least by hash. Statistics of features are summed by shuffles, the chosen ones (at most FEATURES) go to the driver. Every document is scored
whole, by one pass of an automaton of the chosen sequences.

Defined results: null and empty texts have no feature and score as the intercept says; nothing labelled, or one class alone, leaves
nothing to tell apart: every score is 0.5; a document with several labels is toxic if one is; rows without a label are not learnt from;
repeated rows score alike; columns other than doc_id and text are kept or not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.hashing import small
from readloom.session import drop_written, ship, written

MAX_LABELLED = 6000
FEATURES = 1024
LEAST_G2 = 15.0
LENGTHS = range(4, 9)
THRESHOLD = 0.7
L2, COUNTERFACTUAL = 3e-5, 1.0

#: Identity terms, by kind of group; a swap names the next group of the same line.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"), ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "natives", "refugees"), ("disabled", "able"), ("old", "young"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_NEXT = {t: line[(i + 1) % len(line)] for line in IDENTITY for i, t in enumerate(line)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.I)
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
_CUT = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: str | None) -> str:
    """Lower-cased, everything but letters, digits and characters beyond ASCII as spaces, one space at either end."""
    return " " + (text or "").lower().encode("utf-8", "replace").translate(_CUT).decode("utf-8", "replace") + " "


def swapped(text: str) -> str | None:
    """The counterfactual: every sentence with identity terms names the next groups; None if there are none."""
    if not _TERM.search(text):
        return None
    return "".join(_TERM.sub(lambda m: _NEXT[m[1].lower()], s) for s in _SENTENCE.findall(text))


def mentioned(text: str) -> tuple[str, str]:
    """A text without identity terms with a neutral mention after the first word of one of its sentences, and its counterfactual; a hash of the text chooses."""
    at = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    line = IDENTITY[at % len(IDENTITY)]
    spans = [m.span() for m in _SENTENCE.finditer(text) if m[0].strip()] or [(0, len(text))]
    low, high = spans[at // 64 % len(spans)]
    head = re.match(r"\s*\S*", text[low:high]).end() + low
    one, other = line[at // 4096 % len(line)], line[(at // 4096 + 1) % len(line)]
    return f"{text[:head]} {one} {text[head:]}", f"{text[:head]} {other} {text[head:]}"


def sequences(word: str) -> set[str]:
    """The features of a word."""
    w = f" {word} "
    return {w[i : i + n] for n in LENGTHS for i in range(len(w) - n + 1)}


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = [(f, pos, n) for (f, pos), n in counts.items()]
        counts.clear()
        return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["f", "y", "n"])

    for batch in small(batches):
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((f, y) for f in {f for w in set(plain(text).split()) for f in sequences(w)})
            if len(counts) > 300_000:
                yield out()
    yield out()


class Features:
    """An automaton of the chosen sequences."""

    def __init__(self, chosen: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, f in enumerate(chosen):
            self.automaton.add_word(f, i)
        self.any = bool(chosen)
        if self.any:
            self.automaton.make_automaton()

    def of(self, text: str | None) -> list[int]:
        return sorted({i for _, i in self.automaton.iter(plain(text))}) if self.any and text else []


def _vectors(chosen: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(chosen)
        for batch in small(batches):
            own, one, other = [], [], []
            for text in batch.column(0).to_pylist():
                own.append(features.of(text))
                twin = swapped(text or "")
                a, b = mentioned(text or "") if twin is None else (text, twin)
                one.append(features.of(a))
                other.append(features.of(b))
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column(1), *(pa.array(x, kind) for x in (own, one, other))], names=["y", "own", "one", "other"])

    return run


def fit(y: np.ndarray, own: list[list[int]], pairs: list[tuple[list[int], list[int]]], n: int, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss + L2 |w|^2 / 2 + penalty times the mean squared change over pairs of counterfactuals; damped Newton steps."""
    share = float(y.mean()) if len(y) else 0.5
    if n == 0 or share in (0.0, 1.0):
        return np.zeros(n), 0.0
    x = np.zeros((len(y), n + 1), np.float32)
    x[:, n] = 1
    for i, f in enumerate(own):
        x[i, f] = 1
    pairs = [(a, b) for a, b in pairs if a != b]  # equal ones have no change
    d = np.zeros((len(pairs), n + 1), np.float32)
    for k, (a, b) in enumerate(pairs):
        d[k, a] += 1
        d[k, b] -= 1
    fixed = np.full(n + 1, L2)
    fixed[n] = 1e-9
    change = (2 * penalty / len(d)) * (d.T @ d).astype(np.float64) if len(d) else 0.0

    def loss(w: np.ndarray) -> float:
        m = x @ w
        return float((np.logaddexp(0, m) - y * m).mean() + (fixed * w * w).sum() / 2 + (w @ (change @ w) / 2 if len(d) else 0.0))

    w = np.zeros(n + 1)
    w[n] = np.log(share / (1 - share))
    now = loss(w)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + fixed * w + (change @ w if len(d) else 0.0)
        s = (p * (1 - p) / len(y)).astype(np.float32)
        h = (x.T @ (x * s[:, None])).astype(np.float64) + np.diag(fixed + 1e-7) + change
        move, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and (new := loss(w - size * move)) > now:
            size /= 2
        if size <= 1e-4:
            break
        w, gain, now = w - size * move, now - new, new
        if gain < 1e-7:
            break
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, learn, penalty: float = COUNTERFACTUAL) -> tuple[list[str], np.ndarray, float]:
    """Chosen sequences, their weights and the intercept, from labels (doc_id, toxic) of which learn is true of doc_id."""
    spark = docs.sparkSession
    ship(spark)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("y")).where(learn)
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    one = met.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    sample = written(one.select("doc_id", F.col("m.text").alias("text"), "y"), "labelled")
    sizes = dict(sample.groupBy("y").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        drop_written(sample)
        return [], np.zeros(0), 0.0
    seen = sample.repartition("doc_id").select("text", "y").mapInArrow(_occurrences, "f string, y long, n long").groupBy("f").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("a"), F.sum(F.expr("if(y = 1, 0, n)")).alias("b"))
    n = bad + good
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    with_f = F.col("a") + F.col("b")
    g2 = 2 * (term(F.col("a"), with_f * bad / n) + term(F.col("b"), with_f * good / n) + term(bad - F.col("a"), (n - with_f) * bad / n) + term(good - F.col("b"), (n - with_f) * good / n))
    best = seen.where("a + b >= 3").withColumn("g", g2).where(F.col("g") >= LEAST_G2).orderBy(F.desc(F.round("g", 6)), "f").limit(FEATURES)
    chosen = [r["f"] for r in best.select("f").collect()]
    rows = sorted(map(tuple, sample.select("text", "y").mapInArrow(_vectors(chosen), "y long, own array<int>, one array<int>, other array<int>").collect()))
    drop_written(sample)
    pairs = [p for _, own, one, other in rows for p in ((one, other), (own, one))]
    w, b = fit(np.array([r[0] for r in rows], np.float32), [r[1] for r in rows], pairs, len(chosen), penalty)
    return chosen, w, b


def _scores(texts: list, features: Features, w: np.ndarray, b: float) -> np.ndarray:
    return np.array([1 / (1 + np.exp(-np.clip(b + float(w[features.of(t)].sum()), -30, 30))) for t in texts])


def _scorer(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, w, b = model
        features = Features(chosen)
        for batch in small(batches):
            score = _scores(batch.column(1).to_pylist(), features, w, b)
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def _keeper(model, at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, w, b = model
        features = Features(chosen)
        for batch in small(batches):
            yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), features, w, b) < THRESHOLD, pa.bool_()))

    return run


def held_out(doc_id="doc_id"):
    """Rows never learnt from: crc32 of doc_id as text leaves 1 on division by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    model = train(docs, labels, ~held_out())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scorer(model), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; all columns as they were."""
    model = train(docs, labels, ~held_out())
    return docs.mapInArrow(_keeper(model, docs.columns.index("text")), docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    found = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")

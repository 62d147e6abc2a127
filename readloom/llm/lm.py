"""Language-model scoring: whole-document log-likelihood by a gated recurrent model, beside an add-one unigram base.

Statistics: every training document's words are counted (per-task partial counts, then one shuffled sum); the number of tokens, of distinct
tokens and the count of each word come from all of them.

Model: tokens of the recurrent model are the end, the most frequent words, and BUCKETS classes of all other words by a hash of their last three
bytes; a word of a bucket has the add-one probability of its count within the bucket, with one place for unseen words. So the model gives
every text a probability. It is trained on every training document once: in each of ROUNDS rounds replicas start from the same parameters, each on a
shard of about REPLICA_TOKENS tokens, and are averaged, weighted by their tokens (tree-wise, so few reach the driver). Texts go to rounds and
shards by a hash of doc_id and text, so scores do not depend on partitions.

Counts of words: the frequent ones (at most HEAD words of at most 64 bytes, a fixed bound) are broadcast; all others are joined by a
shuffle, so no vocabulary is too large.

Defined results: a null text is the empty one: one token, its end; null doc_ids hash as the empty text and are kept; repeated rows
each give their row; columns other than doc_id and text are not read, whatever their names; with nothing to learn from, the base is log10(1/1) and the model is uniform.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import gru
from readloom.session import drop_written, ship, written

CLASSES, SIZE = 16, 32
BUCKETS = 64
HEAD = 1 << 18
HEAD_BYTES = 64
SLICES = 1 << 16
RATES = (0.02, 0.01, 0.005)
ROUNDS = len(RATES)
GATHER = 16
REPLICA_TOKENS = 1 << 20
PARTIAL = 1_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
        counts.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words(text))
        if len(counts) > PARTIAL:
            yield out()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts; lower-cased words as bytes."""
    return docs.select(F.col("text").cast("string")).mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The broadcast part of the counts, with the recurrent model's number of each word: 0 the end, then words and buckets by count."""

    def __init__(self, head: bytes, numbers: np.ndarray, bucket_numbers: np.ndarray, end: int):
        table = pa.ipc.open_stream(head).read_all()
        self.at = {w: i for i, w in enumerate(table["word"].to_pylist())}
        self.logs = np.concatenate([np.log10(table["c"].to_numpy() + 1.0), [0.0]])
        self.numbers, self.buckets, self.end = np.concatenate([numbers, [-1]]).astype(np.int32), bucket_numbers, end


_held: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    if shared.value[0] not in _held:
        _held.clear()
        _held[shared.value[0]] = Vocabulary(*shared.value[1:])
    return _held[shared.value[0]]


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, head_sum double, rest_sum double, ids binary, tail array<binary>, tail_n array<long>"


def _encoder(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, rid = _vocabulary(shared), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in ENCODED.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                ws = words(text)
                at = np.array([v.at.get(w, -1) for w in ws], np.int64)
                ids, logs = v.numbers[at], v.logs[at]
                tail: Counter = Counter()
                for i in np.flatnonzero(ids < 0).tolist():
                    w = ws[i]
                    ids[i] = v.buckets[bucket(w)]
                    if at[i] < 0:
                        tail[w] += 1
                own = v.numbers[at] >= 0
                rows.append((len(ws) + 1, int((at >= 0).sum()), float(logs.sum()), float(logs[~own].sum()), np.append(ids, 0).astype("<u2").tobytes(), list(tail), list(tail.values())))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(np.arange(rid, rid + len(rows))), batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)
            rid += len(rows)

    return run


def _replica(shared, rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, ids) by shard to the parameters of each shard's replica."""
        held: list[np.ndarray] = []

        def trained(shard: int) -> pa.RecordBatch:
            ids, p = np.concatenate(held), gru.unpack(shared.value, CLASSES, SIZE)
            held.clear()
            gru.train(p, ids, rate)
            return pa.record_batch([pa.array([shard], pa.int64()), pa.array([float(len(ids))]), pa.array([gru.pack(p)], pa.binary())], names=["part", "n", "p"])

        now = None
        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and shard != now:
                    yield trained(now)
                now = shard
                held.append(np.frombuffer(ids, "<u2"))
        if held:
            yield trained(now)

    return run


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0.0, None
    for batch in batches:
        for k, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = np.frombuffer(raw, "<f4").astype(np.float64) * k
            n, total = n + k, own if total is None else total + own
    if total is not None:
        yield pa.record_batch([pa.array([0], pa.int64()), pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["part", "n", "p"])


REPLICA = "part long, n double, p binary"


def train(encoded: DataFrame, p: dict[str, np.ndarray], tokens: int) -> dict[str, np.ndarray]:
    """Rounds of replicas over all training texts (of so many tokens), each text in one round; averages of groups of replicas come to the driver."""
    sc = encoded.sparkSession.sparkContext
    shards = max(1, round(tokens / ROUNDS / REPLICA_TOKENS))
    groups = max(GATHER, math.isqrt(shards))
    dealt = encoded.where(~F.col("held_out")).select("ids", F.xxhash64("doc_id", "ids").alias("h"))
    for r, rate in enumerate(RATES):
        own = dealt.where(F.pmod("h", F.lit(ROUNDS)) == r).select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "ids")
        shared = sc.broadcast(gru.pack(p))
        sorted_by_shard = own.repartition("shard").sortWithinPartitions("shard", "h", "ids").select("shard", "ids")
        replicas = sorted_by_shard.mapInArrow(_replica(shared, rate), REPLICA).withColumn("g", F.pmod("part", F.lit(groups)))
        means = replicas.repartition(groups, "g").sortWithinPartitions("part").select("part", "n", "p").mapInArrow(_sum, REPLICA).collect()
        if total := sum(m["n"] for m in means):
            means.sort(key=lambda m: (m["n"], bytes(m["p"])))
            mean = sum(np.frombuffer(m["p"], "<f4").astype(np.float64) * (m["n"] / total) for m in means)
            p = gru.unpack(mean.astype("<f4").tobytes(), CLASSES, SIZE)
    return p


def _scorer(shared, zs: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.unpack(shared.value, CLASSES, SIZE)
        for batch in batches:
            texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(1).to_pylist()]
            found = gru.score(p, texts) / np.log(10)
            spread = np.array([zs[t].sum() for t in texts]) if texts else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(found - spread)], names=["rid", "model"])

    return run


def _head(counts: DataFrame) -> pa.Table:
    """The most frequent words of at most HEAD_BYTES, HEAD of them or so: by bins of counts, and of the bin that is too large a share by hash."""
    short = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("b", F.floor(F.log2("c") * 16).cast("long"))
    bins = {r["b"]: r["n"] for r in short.groupBy("b").agg(F.count("*").alias("n")).collect()}
    total, share, b = 0, SLICES, None
    for b in sorted(bins, reverse=True):
        if total + bins[b] > HEAD:
            share = int(SLICES * 0.95 * (HEAD - total) / bins[b])
            break
        total += bins[b]
    some = (F.col("b") > b) | ((F.col("b") == b) & (F.pmod(F.xxhash64("word"), F.lit(SLICES)) < share)) if bins else F.lit(False)
    table = short.where(some).select("word", "c").toArrow()
    return table.cast(pa.schema([("word", pa.binary()), ("c", pa.int64())])).sort_by([("c", "descending"), ("word", "ascending")])


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """docs (doc_id, text), held_out: a column that is true where a document is not learnt from. One row per document with base and model scores."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = written(word_counts(rows.where("not held_out")), "counts")
    ends = rows.where("not held_out").select("doc_id").count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    head = _head(counts)
    top = head.slice(0, CLASSES * SIZE - 1 - BUCKETS)
    frequent = top["word"].to_pylist()
    known = spark.createDataFrame([(bytearray(w),) for w in frequent], "word binary")
    others = counts.join(F.broadcast(known), "word", "left_anti").withColumn("b", F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(BUCKETS)))
    per = {r["b"]: (r["n"], r["v"]) for r in others.groupBy("b").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    z = np.array([sum(per.get(b, (0, 0))) + 1 for b in range(BUCKETS)], np.float64)
    # numbers by count: words and buckets together, so that a class has tokens of like frequency
    sizes = np.concatenate([top["c"].to_numpy().astype(np.float64), [per.get(b, (0, 0))[0] for b in range(BUCKETS)]])
    number = np.empty(len(sizes), np.int64)
    number[np.argsort(-sizes, kind="stable")] = np.arange(1, len(sizes) + 1)
    numbers = np.full(head.num_rows, -1, np.int64)
    numbers[: len(frequent)] = number[: len(frequent)]
    counted = np.zeros(CLASSES * SIZE)
    counted[0], counted[number] = ends, sizes
    zs = np.zeros(CLASSES * SIZE)
    zs[number[len(frequent) :]] = np.log10(z)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as w:
        w.write_table(head)
    raw = sink.getvalue().to_pybytes()
    shared = spark.sparkContext.broadcast((hash((raw, n)), raw, numbers, number[len(frequent) :], ends))
    encoded = written(rows.mapInArrow(_encoder(shared), ENCODED), "encoded")
    tails = encoded.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("rid", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("k"))
    found = tails.join(counts, "word").groupBy("rid").agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("tail_sum"))
    found = written(found, "tails")
    p = train(encoded.select("doc_id", "held_out", "ids"), gru.initial(counted, SIZE), n)
    model = encoded.select("rid", "ids").mapInArrow(_scorer(spark.sparkContext.broadcast(gru.pack(p)), zs), "rid long, model double")
    base = encoded.drop("ids", "tail", "tail_n").join(found, "rid", "left").join(model, "rid")
    end = float(np.log10(ends + 1.0))
    tail = F.coalesce("tail_sum", F.lit(0.0))
    drop_written(counts)
    return base.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("head_sum") + tail + end - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"),
        (F.col("model") + F.col("rest_sum") + tail).alias("score"),
    )


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score_documents(docs, key % 7 == 2)

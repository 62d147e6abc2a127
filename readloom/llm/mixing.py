"""Mixing sources to target weights by subset-sum budget fitting.

Each source takes every document `k` times, as often as its target allows, and then fits the rest of its budget:
documents are counted by exact length, a proportional share of each length is taken, and a bounded-knapsack dynamic
program over the remaining counts closes the gap. Which documents of a length are taken follows a seeded hash.

Documents of one source and length are dealt to 4096 hash buckets, so a group of any size ranks only
within a bucket; counts are summed before they are shuffled. Sources, lengths, documents and buckets stay distributed: sources are ranked by a
range-partitioned sort, and targets come of a few rounds of sums over the table of sources.

Defined results: a null text has size 0; documents of size 0 take 0; a null source is a source of its own and comes
last; sources without words have target 0; repeated rows are documents of their own; every column of the documents is kept as it is, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import drop_written, ship, written

SEED = 17
WEIGHTS = (1, 2, 3)
REPEATS = 3
BUCKETS = 4096
DP_BUDGET = 16384


def targets(sources: DataFrame) -> DataFrame:
    """sources (key, total) with the weight by their order, and target: shares by weight of the sum of all sizes, held at REPEATS times a source's own size, the excess shared again."""
    by = [F.col("key") == "n", F.col("key")]
    parts = max(1, min(64, sources.rdd.getNumPartitions()))
    dealt = sources.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranked = written(dealt.select("key", "total", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranked")
    before, n = {}, 0
    for part, rows in sorted(ranked.groupBy("part").count().collect()):  # a number for each of at most 64 parts
        before[part], n = n, n + rows
    place = F.col("at") + F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("part")) if before else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    weighed = written(ranked.select("key", "total", weight.alias("weight")), "weighed")
    drop_written(ranked)
    per, told = -1.0, None
    while True:  # shares rise from round to round, until no further source is over its limit
        over = F.col("weight") * F.lit(per) > REPEATS * F.col("total")
        sums = weighed.agg(F.coalesce(F.sum("total"), F.lit(0)) - F.coalesce(F.sum(F.when(over, REPEATS * F.col("total"))), F.lit(0)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if sums[2] == told or not sums[1]:
            break
        per, told = sums[0] / sums[1], sums[2]
    out = weighed.select("key", "total", F.when(F.col("weight") * F.lit(per) > REPEATS * F.col("total"), REPEATS * F.col("total")).otherwise(F.col("weight") * F.lit(per)).cast("double").alias("target"))
    out._readloom_path = weighed._readloom_path  # noqa: SLF001
    return out


def knapsack(lengths: Iterable[int], counts: Iterable[int], budget: int) -> dict[int, int]:
    """How many of each length (at most counts) give the largest sum that is not over budget; exact."""
    items = [(w * part, w, part) for w, c in zip(lengths, counts, strict=True) if 0 < w <= budget for part in _parts(min(c, budget // w))]
    bits, mask, via = 1, (1 << (budget + 1)) - 1, np.full(budget + 1, -1, np.int32)
    for i, (weight, _, _) in enumerate(items):
        if new := (bits << weight) & mask & ~bits:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little"))
            via[at] = i
            bits |= new
            if bits >> budget & 1:
                break
    at, out = bits.bit_length() - 1, {}
    while at > 0:
        weight, w, part = items[via[at]]
        out[w] = out.get(w, 0) + part
        at -= weight
    return out


def _parts(n: int) -> list[int]:
    """Multiplicities that give every number up to n as sums of some of them."""
    out, k = [], 1
    while n > 0:
        out.append(min(k, n))
        n, k = n - k, 2 * k
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length, so that the words come near budget: the fullest sum within it, or one document more if that is nearer."""
    total = int((lengths * counts).sum())
    budget = min(budget, total)
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    for i in range(len(lengths)):
        take[i] = int(counts[i]) * budget // total if lengths[i] else 0
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):  # down to what the dynamic program covers
        if left <= DP_BUDGET:
            break
        if 0 < lengths[i] <= left - DP_BUDGET:
            more = min(int(counts[i] - take[i]), (left - DP_BUDGET) // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    free = counts - take
    where = {int(w): i for i, w in enumerate(lengths)}
    for w, n in knapsack(map(int, lengths), map(int, free), int(left)).items():
        take[where[w]] += n
        left -= w * n
    over = np.where((counts > take) & (lengths > left), lengths - left, left)  # one more document may come nearer from above
    if len(over) and over.min() < left:
        take[over.argmin()] += 1
    return take


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    total, target = int(group["total"].iloc[0]), float(group["target"].iloc[0])
    k = min(REPEATS, int(target // total)) if total else 0
    take = fit(lengths, counts, round(target) - k * total) if k < REPEATS else np.zeros(len(lengths), np.int64)
    return pd.DataFrame({"key": group["key"], "size": lengths, "take": take, "k": k, "total": total, "target": target})


def keyed(docs: DataFrame, row: Column, seed: int = SEED) -> DataFrame:
    """What the mix works on: the struct `row`, the source's key, the size, a seeded rank and its bucket."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"), source, text)
    return docs.select(
        row.alias("row"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        rank.alias("rank"), F.pmod(F.shiftrightunsigned(rank, 20), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("doc_id").cast("string").alias("tie"),
    )


def mixed(rows: DataFrame) -> DataFrame:
    """`keyed` rows as (row, size, total and target of the source, times: how often the mix takes it)."""
    ship(rows.sparkSession)
    base = written(rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")), "mix")
    hist = base.groupBy("key", "size").agg(F.sum("n").alias("n"))
    table = targets(hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("total")))
    plan = hist.join(table, "key").groupBy("key").applyInPandas(_fit, "key string, size long, take long, k long, total long, target double")
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    deal = base.join(plan, ["key", "size"]).withColumn("left", F.col("take") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = rows.join(written(deal.drop("take", "n"), "deal"), ["key", "size", "bucket"])
    drop_written(base)
    drop_written(table)
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("rank", "tie"))
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("k") + F.when(place <= F.col("left"), 1).otherwise(0))
    return met.select("row", "size", "total", "target", times.cast("int").alias("times"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    found = mixed(keyed(docs, F.struct("*"), seed))
    return found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def op8_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = mixed(written(keyed(docs, F.struct("doc_id")), "sizes"))
    return found.select("row.doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("times") * F.col("size")).alias("taken"))

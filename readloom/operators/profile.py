"""Quality-control profiles as tidy tables. Kernels sum within a batch of rows before anything is shuffled.

Defined results: reads without bases count as reads and give no cycles; a mate that is null is no read; no reads, no rows; repeated ordinals are reads of
their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import mates
from readloom.session import ship


def long_form(reads: DataFrame, stage: str = "before") -> DataFrame:
    """Pairs as one row for each mate: (stage, mate, ordinal, seq, qual)."""
    each = F.array(*(F.struct(F.lit(i).alias("mate"), F.col(f"seq{i}").alias("seq"), F.col(f"qual{i}").alias("qual")) for i in (1, 2)))
    return reads.select("ordinal", F.explode(each).alias("r")).where("r.seq is not null").select(F.lit(stage).alias("stage"), "r.mate", "ordinal", "r.seq", "r.qual")


def after(done: DataFrame, o) -> DataFrame:
    """Reads that the chain lets pass, as one row each, like `long_form`: merged pairs and, with include_unmerged, single mates count as mate 1."""
    kept = done.where("not skipped")
    if o.dedup and "duplicate" in done.columns:
        kept = kept.where("not duplicate")
    one = lambda mate, seq, qual: F.struct(F.lit(mate).alias("mate"), F.col(seq).alias("seq"), F.col(qual).alias("qual"))
    ok1, ok2, single = F.col("fail1") == 0, F.col("fail2") == 0, F.col("seq2").isNull()
    none = F.lit(None)
    if not o.merge:
        each = F.when(ok1 & single, F.array(one(1, "seq1", "qual1"))).when(ok1 & ok2, F.array(one(1, "seq1", "qual1"), one(2, "seq2", "qual2")))
    else:
        alone = F.filter(F.array(F.when(ok1, one(1, "seq1", "qual1")), F.when(ok2, one(1, "seq2", "qual2"))), lambda x: x.isNotNull()) if o.include_unmerged else none
        each = F.when(F.col("merged_seq").isNotNull(), F.when(ok1, F.array(one(1, "merged_seq", "merged_qual")))).otherwise(alone)
    return kept.select("ordinal", F.explode(each).alias("r")).select(F.lit("after").alias("stage"), "r.mate", "ordinal", "r.seq", "r.qual")


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["stage", "mate", "kind", "cycle", "code", "n", "qsum"]
    for batch in batches:
        stage, mate = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False)
        for s in np.unique(stage):
            for m in np.unique(mate[stage == s]):
                own = np.flatnonzero((stage == s) & (mate == m))
                for low in range(0, len(own), 8192):
                    take = pa.array(own[low : low + 8192])
                    seq, size = mates.matrix(batch.column(2).take(take))
                    qual, _ = mates.matrix(batch.column(3).take(take))
                    inside = np.arange(seq.shape[1])[None, :] < size[:, None]
                    q = qual.astype(np.int64) - 33
                    cycle = np.broadcast_to(np.arange(seq.shape[1]), seq.shape)[inside]
                    base = seq[inside]
                    base = np.where((base >= 97) & (base <= 122), base - 32, base).astype(np.int64)
                    at = cycle * 256 + base
                    n, total = np.bincount(at), np.bincount(at, q[inside])
                    hit = np.flatnonzero(n)
                    hist = np.bincount(np.clip(q[inside], 0, None))
                    level = np.flatnonzero(hist)
                    rows = len(hit) + len(level)
                    yield pa.record_batch([
                        pa.array([str(s)] * rows), pa.array([int(m)] * rows, pa.int32()), pa.array(["cycle"] * len(hit) + ["qual"] * len(level)),
                        pa.array(np.concatenate([hit // 256, np.zeros(len(level), np.int64)]).astype(np.int32)), pa.array(np.concatenate([hit % 256, level]).astype(np.int32)),
                        pa.array(np.concatenate([n[hit], hist[level]]).astype(np.int64)), pa.array(np.concatenate([total[hit], np.zeros(len(level))]).astype(np.int64)),
                    ], names=names)


def counts(rows: DataFrame) -> DataFrame:
    """(stage, mate, kind, cycle, code, n, qsum): bases by cycle, and qualities; summed in the kernel, then once more."""
    ship(rows.sparkSession)
    part = rows.select("stage", "mate", "seq", "qual").mapInArrow(_counts, "stage string, mate int, kind string, cycle int, code int, n long, qsum long")
    return part.groupBy("stage", "mate", "kind", "cycle", "code").agg(F.sum("n").alias("n"), F.sum("qsum").alias("qsum"))


def cycle_quality(rows: DataFrame) -> DataFrame:
    """Per cycle and base: count and sum of qualities."""
    return counts(rows).where("kind = 'cycle'").select("stage", "mate", F.col("cycle"), F.char("code").alias("base"), "n", "qsum")


def quality_histogram(rows: DataFrame) -> DataFrame:
    return counts(rows).where("kind = 'qual'").select("stage", "mate", F.col("code").alias("q"), "n")


TOTALS = ("reads", "bases", "q20_bases", "q30_bases", "q40_bases", "gc_bases", "max_len")


def _bytes(column: pa.Array) -> np.ndarray:
    """How often each byte stands in a string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.bincount(np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(ends) else np.zeros(0, np.uint8), minlength=256)


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stage, mate, seq, qual) to one row of TOTALS for each stage and mate of a task."""
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        group = pc.binary_join_element_wise(batch.column(0), batch.column(1).cast(pa.string()), "\t")
        for name in group.unique().to_pylist():
            seq, qual = (batch.column(i).filter(pc.equal(group, name)) for i in (2, 3))
            bases, levels = _bytes(seq), _bytes(qual)
            stage, mate = name.split("\t")
            own = found.setdefault((stage, int(mate)), [0] * len(TOTALS))
            new = [len(seq), int(bases.sum()), *(int(levels[33 + q :].sum()) for q in (20, 30, 40)), int(sum(bases[ord(b)] for b in "GCgc"))]
            own[:6] = (x + y for x, y in zip(own, new, strict=False))
            own[6] = max(own[6], pc.max(pc.binary_length(seq)).as_py() or 0)
    cols = list(zip(*((*k, *v) for k, v in found.items()), strict=True)) or [()] * 9
    types = (pa.string(), pa.int32(), *[pa.int64()] * 6, pa.int32())
    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["stage", "mate", *TOTALS])


def totals(rows: DataFrame) -> DataFrame:
    """Reads, bases, bases of Q20, Q30, Q40 and more, GC bases, longest read; per stage and mate. Bytes are counted within a task, its sums are shuffled."""
    ship(rows.sparkSession)
    part = rows.select("stage", "mate", "seq", "qual").mapInArrow(_totals, "stage string, mate int, " + ", ".join(f"{c} {'int' if c == 'max_len' else 'long'}" for c in TOTALS))
    return part.groupBy("stage", "mate").agg(*(F.sum(c).alias(c) for c in TOTALS[:-1]), F.max("max_len").alias("max_len"))


def rate(x: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(x) / F.col(of)).otherwise(0.0)


def summary(rows: DataFrame) -> DataFrame:
    """Totals and rates per stage (mate null) and per mate, as grouping sets."""
    t = totals(rows).rollup("stage", "mate").agg(*(F.sum(c).alias(c) for c in ("reads", "bases", "q20_bases", "q30_bases", "q40_bases", "gc_bases")), F.max("max_len").alias("max_len")).where("stage is not null")
    return t.select("*", *(F.round(rate(f"{q}_bases", "bases"), 6).alias(f"{q}_rate") for q in ("q20", "q30", "q40", "gc")), F.when(F.col("reads") > 0, F.floor(F.col("bases") / F.col("reads"))).otherwise(0).cast("long").alias("mean_length"))


def _kmers(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(256, 4, np.int16)
        for i, b in enumerate("ACGT"):
            code[ord(b)] = code[ord(b.lower())] = i
        for batch in batches:
            stage, mate = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False)
            for s in np.unique(stage):
                for m in np.unique(mate[stage == s]):
                    seq, _ = mates.matrix(batch.column(2).take(pa.array(np.flatnonzero((stage == s) & (mate == m)))))
                    n, width = np.zeros(4**k, np.int64), seq.shape[1] - k + 1
                    for low in range(0, len(seq) if width > 0 else 0, 2048):
                        c = code[seq[low : low + 2048]]
                        number, good = np.zeros((len(c), width), np.int16), np.ones((len(c), width), bool)
                        for i in range(k):
                            part = c[:, i : i + width]
                            number = number * 4 + part
                            good &= part < 4
                        n += np.bincount(number[good], minlength=4**k)
                    hit = np.flatnonzero(n)
                    yield pa.record_batch([pa.array([str(s)] * len(hit)), pa.array([int(m)] * len(hit), pa.int32()), pa.array(hit.astype(np.int32)), pa.array(n[hit])], names=["stage", "mate", "code", "n"])

    return run


def kmers(rows: DataFrame, k: int = 5) -> DataFrame:
    """Counts of k-mers of A, C, G, T in either case; every k-mer has a row for each stage and mate that occur."""
    ship(rows.sparkSession)
    found = rows.select("stage", "mate", "seq").mapInArrow(_kmers(k), "stage string, mate int, code int, n long").groupBy("stage", "mate", "code").agg(F.sum("n").alias("n"))
    every = rows.select("stage", "mate").distinct().select("stage", "mate", F.explode(F.sequence(F.lit(0), F.lit(4**k - 1))).alias("code"))
    name = F.concat(*(F.substring(F.lit("ACGT"), F.pmod(F.shiftright("code", 2 * i), F.lit(4)) + 1, F.lit(1)) for i in range(k - 1, -1, -1)))
    return every.join(found, ["stage", "mate", "code"], "left").select("stage", "mate", name.alias("kmer"), F.coalesce("n", F.lit(0)).alias("n"))


def insert_sizes(processed: DataFrame, most: int = 512) -> DataFrame:
    """(size, n) of pairs with an overlap; all of `most` and more count at most."""
    return processed.where("not skipped and insert_size is not null").groupBy(F.least("insert_size", F.lit(most)).alias("size")).agg(F.count("*").alias("n"))


def insert_peak(processed: DataFrame, most: int = 512) -> DataFrame:
    """One row (peak, unknown): the most frequent insert size under `most`, the least of equals, and the pairs without a size under it."""
    size = F.least(F.coalesce("insert_size", F.lit(most)), F.lit(most))
    n = processed.where("not skipped and seq2 is not null").groupBy(size.alias("size")).agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("size") < most, F.struct("n", (-F.col("size")).alias("s"))))
    return n.agg(F.coalesce(-best["s"], F.lit(0)).cast("int").alias("peak"), F.coalesce(F.sum(F.when(F.col("size") == most, F.col("n"))), F.lit(0)).alias("unknown"))


def event_totals(done: DataFrame, o) -> DataFrame:
    """One row: records, adapter, correction and poly-X totals (by base in the order ATCG), merged pairs."""
    kept = lambda x: F.when(~F.col("skipped"), x)
    total = lambda x: F.coalesce(F.sum(kept(x)), F.lit(0)).cast("long")
    poly = [(b, i) for i, b in enumerate("ATCG")]
    reads = [sum((F.when(F.col(f"polyx_base{m}") == i, 1).otherwise(0) for m in (1, 2)), F.lit(0)) for _, i in poly]
    bases = [sum((F.when(F.col(f"polyx_base{m}") == i, F.col(f"polyx_n{m}")).otherwise(0) for m in (1, 2)), F.lit(0)) for _, i in poly]
    merged = (F.col("merged_seq").isNotNull() & (F.col("fail1") == 0)) & (~F.col("duplicate") if o.dedup and "duplicate" in done.columns else F.lit(True))
    return done.agg(
        F.count("*").alias("records"), *(total(F.col(c)).alias(c) for c in ("adapter_reads", "adapter_bases", "corrected_reads", "corrected_bases")),
        *(total(x).alias(f"polyx_reads_{b}") for x, (b, _) in zip(reads, poly, strict=True)), *(total(x).alias(f"polyx_bases_{b}") for x, (b, _) in zip(bases, poly, strict=True)),
        total(merged.cast("int")).alias("merged_pairs"),
    )


def failure_counts(processed: DataFrame, o) -> DataFrame:
    """Reads by reason: a pair counts twice under the graver of its mates' reasons; with include_unmerged each mate of an unmerged pair under its own."""
    from readloom.operators.chain import REASONS

    pair = F.greatest("fail1", "fail2")
    kept = processed.where("not skipped")
    if o.merge and o.include_unmerged:
        each = F.when(F.col("merged_seq").isNotNull(), F.array(F.struct(pair.alias("r"), F.lit(2).alias("w")))).otherwise(F.array(F.struct(F.col("fail1").alias("r"), F.lit(1).alias("w")), F.struct(F.col("fail2").alias("r"), F.lit(1).alias("w"))))
    else:
        each = F.array(F.struct(pair.alias("r"), F.when(F.col("seq2").isNull(), 1).otherwise(2).alias("w")))
    label = F.element_at(F.array(*map(F.lit, REASONS)), F.col("e.r") + 1)
    return kept.select(F.explode(each).alias("e")).groupBy(label.alias("reason")).agg(F.sum("e.w").alias("reads"))


def content_curves(cycles: DataFrame) -> DataFrame:
    """Shares of A, C, G, T, of everything else, and of G and C together, per cycle."""
    of = lambda *b: F.round(F.coalesce(F.sum(F.when(F.col("base").isin(*b), F.col("n"))), F.lit(0)) / F.sum("n"), 6)
    other = F.round(F.coalesce(F.sum(F.when(~F.col("base").isin(*"ACGT"), F.col("n"))), F.lit(0)) / F.sum("n"), 6)
    return cycles.groupBy("stage", "mate", "cycle").agg(*(of(b).alias(b.lower()) for b in "ACGT"), other.alias("n"), of("G", "C").alias("gc"))


def quality_curves(cycles: DataFrame) -> DataFrame:
    """Mean quality per cycle, and of each base; a base that a cycle lacks has the cycle's mean."""
    mean = F.round(F.sum("qsum") / F.sum("n"), 6)
    of = lambda b: F.coalesce(F.round(F.sum(F.when(F.col("base") == b, F.col("qsum"))) / F.sum(F.when(F.col("base") == b, F.col("n"))), 6), mean)
    return cycles.groupBy("stage", "mate", "cycle").agg(mean.alias("mean"), *(of(b).alias(b.lower()) for b in "ACGT"))

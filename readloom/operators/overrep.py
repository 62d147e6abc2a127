"""Over-represented sequences: candidates from a prefix of the reads, then their counts over every so-manieth read.

The prefix is a fixed number of bases, so candidates are bounded and may be sent to every task. Windows are counted by an
aggregation; only those over their threshold reach the driver. Counting is one scan with sums inside the kernel.

Defined results: null sequences have no windows; no reads, no rows; equal ordinals are read in any order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.sinks import numbered
from readloom.session import ship

#: Bases of the prefix, reads that tell the length, most reads looked at for the prefix.
PREFIX_BASES, LENGTH_READS, MOST_READS = 151 * 10_000, 1000, 1 << 18
#: Fixed values: (least length, least count) of a candidate; a sequence of the reads' length less one or more needs WHOLE.
LEAST, WHOLE = ((100, 5), (40, 20), (20, 100), (10, 500)), 3
#: What a count times the sampling must exceed, by length.
REPORT, REPORT_OTHER = {10: 500, 20: 200, 40: 100, 100: 50}, 20


def steps(longest: int) -> list[int]:
    """Window lengths for reads of this length; a length may be named twice and then counts twice."""
    return [10, 20, 40, 100, max(1, min(150, longest - 2))]


def window_counts(reads: DataFrame, seq: str = "seq1") -> tuple[DataFrame, int]:
    """(sequence, n) of the prefix's windows that reach their threshold, and the longest of the first reads."""
    sizes = reads.select("ordinal", F.coalesce(F.length(seq), F.lit(0)).alias("size")).orderBy("ordinal").limit(MOST_READS).collect()
    longest = max((r["size"] for r in sizes[:LENGTH_READS]), default=0)
    bases, last = 0, -1
    for r in sizes:
        if bases >= PREFIX_BASES:
            break
        bases, last = bases + r["size"], r["ordinal"]
    prefix = reads.where(F.col("ordinal") <= last).select(F.col(seq).alias("s"))
    each = prefix.select("s", F.explode(F.array(*map(F.lit, steps(longest)))).alias("k")).where("length(s) > k")
    cut = each.select("k", F.explode(F.expr("sequence(1, length(s) - k)")).alias("i"), "s").select(F.expr("substr(s, i, k)").alias("sequence"))
    size = F.length("sequence")
    least = F.when(size >= max(0, longest - 1), WHOLE)
    for at, n in LEAST:
        least = least.when(size >= at, n)
    return cut.groupBy("sequence").agg(F.count("*").alias("n")).where(F.col("n") >= least), longest


def irredundant(counts: dict[str, int]) -> dict[str, int]:
    """counts without sequences inside a longer one that is left, unless ten times as frequent; taken in lexicographic order."""
    left, sizes, holders = dict(counts), sorted({len(x) for x in counts}), defaultdict(set)
    for x in counts:
        for k in sizes:
            if k < len(x):
                for i in range(len(x) - k + 1):
                    if (part := x[i : i + k]) in counts:
                        holders[part].add(x)
    for x in sorted(counts, key=lambda s: s.encode("utf-8", "surrogatepass")):
        if any(y in left and counts[x] // counts[y] < 10 for y in holders[x]):
            del left[x]
    return left


def hits(seq: str, wanted: frozenset[str], lengths: list[int]) -> Iterator[str]:
    """Candidates in a read, for each length from the left; after a hit the scan goes on behind it, one base further."""
    for k in lengths:
        i = 0
        while i < len(seq) - k:
            if (part := seq[i : i + k]) in wanted:
                yield part
                i += k
            i += 1


def _count(wanted: frozenset[str], lengths: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                found.update(hits(seq or "", wanted, lengths))
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["sequence", "n"])

    return run


def _reported(rows: DataFrame, seq: str, wanted: frozenset[str], lengths: list[int], sampling: int) -> DataFrame:
    """(sequence, n) over the given rows, of those frequent enough."""
    counted = rows.select(seq).mapInArrow(_count(wanted, lengths), "sequence string, n long")
    most = F.lit(REPORT_OTHER)
    for k, n in REPORT.items():
        most = F.when(F.length("sequence") == k, n).otherwise(most)
    return counted.groupBy("sequence").agg(F.sum("n").alias("n")).where(sampling * F.col("n") > most)


def overrepresented(reads: DataFrame, seq: str = "seq1", sampling: int = 20) -> DataFrame:
    """(sequence, n) of sequences over-represented in the reads whose ordinal the sampling divides."""
    ship(reads.sparkSession)
    counted, longest = window_counts(reads, seq)
    wanted = frozenset(irredundant({r["sequence"]: r["n"] for r in counted.collect()}))
    return _reported(reads.where(F.col("ordinal") % sampling == 0), seq, wanted, steps(longest), sampling)


def both(raw: DataFrame, passed: DataFrame, mate: int, sampling: int = 20) -> dict[str, dict[str, int]]:
    """Over-represented sequences of a mate by stage: before, by the ordinal read; after, by the place among the reads that passed."""
    ship(raw.sparkSession)
    seq = f"seq{mate}"
    counted, longest = window_counts(raw, seq)
    wanted, lengths = frozenset(irredundant({r["sequence"]: r["n"] for r in counted.collect()})), steps(longest)
    ranked = numbered(passed.where(F.col("mate") == mate).select("ordinal", F.col("seq").alias(seq)))
    rows = {"before": raw.where(F.col("ordinal") % sampling == 0), "after": ranked.where(F.col("rank") % sampling == 0)}
    return {stage: {r["sequence"]: r["n"] for r in _reported(x, seq, wanted, lengths, sampling).collect()} for stage, x in rows.items()}

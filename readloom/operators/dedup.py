"""Duplicates: a record whose key an earlier record (by ordinal) had. No sequential state; the result is that of a scan in input order.

Defined results: null sequences are empty; records without bases are alike; of equal ordinals none is earlier than the other; no reads, no rows; other columns are
kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import mates
from readloom.session import ship, written

#: By accuracy level, the bits of each filter and their number.
LEVELS = {1: (32, 2), 2: (33, 2), 3: (33, 4), 4: (34, 4), 5: (35, 4), 6: (35, 8)}
#: What bases A, T, C, G and all others count in the hash.
CODES = {"A": 7, "T": 222, "C": 74, "G": 31}
OTHER = 13


def key() -> Column:
    """Equal for records of equal bases, all but A, C, G, T being alike; both mates, one after the other."""
    return F.regexp_replace(F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in ("seq1", "seq2"))), "[^ACGT]", "N")


def mark_exact(reads: DataFrame) -> DataFrame:
    """reads with `duplicate`. The least ordinal of each key is found by an aggregation with map-side minima; records are told by ordinal and key, so a key of any number of records is no hot task.

    Records and digests of their keys are written once, as both sides of the join read them; give no more columns than are wanted."""
    keyed = written(reads.withColumn("_k", F.unhex(F.sha2(key(), 256))), "keyed")
    first = keyed.groupBy("_k").agg(F.min("ordinal").alias("ordinal")).withColumn("_first", F.lit(True))
    return keyed.join(first, ["ordinal", "_k"], "left").withColumn("duplicate", F.col("_first").isNull()).select(*reads.columns, "duplicate")


def primes(n: int) -> np.ndarray:
    """The first prime above 10000, then each time the first that is more than 10000 further."""
    out, low = [], 10000
    while len(out) < n:
        k = low + 1
        while any(k % d == 0 for d in range(2, int(k**0.5) + 1)):
            k += 1
        out.append(k)
        low = k + 10000
    return np.array(out, np.uint64)


def _bits(level: int):
    width, n = LEVELS[level]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, code = primes(512 * n), np.full(256, OTHER, np.uint64)
        for b, c in CODES.items():
            code[ord(b)] = c
        for batch in batches:
            text = [(x or "") + (y or "") for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            seq, size = mates.matrix(pa.array(text, pa.string()))
            p = np.arange(seq.shape[1], dtype=np.uint64)
            value = np.where(np.arange(seq.shape[1])[None, :] < size[:, None], code[seq] + p[None, :], np.uint64(0))
            with np.errstate(over="ignore"):
                cols = [(value * table[((p * np.uint64(n) + np.uint64(i)) & np.uint64(512 * n - 1)).astype(np.int64)][None, :]).sum(axis=1, dtype=np.uint64) & np.uint64((1 << width) - 1) for i in range(n)]
            yield pa.record_batch([batch.column(0), *batch.columns[3:], *(pa.array(c.astype(np.int64)) for c in cols)], names=["ordinal", *batch.schema.names[3:], *(f"b{i}" for i in range(n))])

    return run


def mark_bloom(reads: DataFrame, level: int = 1, exact: bool = False) -> DataFrame:
    """reads with `duplicate` as a Bloom filter of this level tells it in input order: every bit of the record was set by some earlier one.

    That is, of each filter the least ordinal with the record's bit is less than its own. Bits of different records meet, the more of them the more records there are;
    with `exact`, an earlier record must have the same key as well. Filters miss no duplicate, so the result is then that of `mark_exact`."""
    ship(reads.sparkSession)
    n = LEVELS[level][1]
    digest = {"_k": F.unhex(F.sha2(key(), 256))} if exact else {}
    names = "ordinal long, " + "_k binary, " * exact + ", ".join(f"b{i} long" for i in range(n))
    bits = written(reads.select("ordinal", "seq1", "seq2", *(c.alias(k) for k, c in digest.items())).mapInArrow(_bits(level), names), "bits")
    entry = lambda i, bit, k: F.struct(F.lit(i).alias("i"), bit.alias("bit"), k.alias("k"))
    none = F.lit(b"")
    each = [entry(i, F.col(f"b{i}"), none) for i in range(n)] + [entry(n, F.lit(0).cast("long"), F.col(k)) for k in digest]
    rows = bits.select("ordinal", F.explode(F.array(*each)).alias("e")).select("ordinal", "e.*")
    first = rows.groupBy("i", "bit", "k").agg(F.min("ordinal").alias("_first"))
    told = rows.join(first, ["i", "bit", "k"]).groupBy("ordinal").agg(F.min((F.col("_first") < F.col("ordinal")).cast("int")).alias("_all"))
    return reads.join(told, "ordinal").withColumn("duplicate", F.col("_all") == 1).drop("_all")

"""SimHash near-duplicate detection with deletion-variant signatures.

A fingerprint is cut into so few segments that of two fingerprints within the radius one segment differs by at most one bit: two
segments of 32 bits for radius 2. Each segment is indexed under its 32 variants with one bit left out; fingerprints that
share a variant meet by an equality join and are verified.

Buckets: one of two gives its pair; one of up to BUCKET fingerprints is verified in a kernel that gives only the links of a spanning
forest; members of larger ones are indexed exactly under all fingerprints with two bits left out, where a bucket holds
at most four. So no link between different fingerprints is lost and nothing grows with the square of a bucket.

`neardup` has the same scheme for documents at a similarity of their shingle sets.

Defined results: null and empty texts have fingerprint zero and link like others; exact copies share a fingerprint; null
doc_ids are kept and belong to their fingerprint's component; repeated rows are kept by `link_documents`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.components import components
from readloom.session import drop_written, ship, written

SEED = 42
RADIUS = 2
BUCKET = 1024

# ---- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of the lower-cased (A-Z) text, repeats included; fewer words: of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, n)
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(bits: np.ndarray, n: int) -> np.ndarray:
    """Packed bits that are set in over half of n."""
    return np.packbits(2 * bits > n, bitorder="little")


def fingerprint(text: str | None, k: int) -> int:
    """64 bits, as a signed number."""
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    bits = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(majority(bits, len(h)).view("<i8")[0])


def _fingerprints(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return run


# ---- links between fingerprints ---------------------------------------------------------------

#: Of variant j (0-63): the number j and the segment it belongs to, without bit j % 32.
_VARIANT = "shiftleft(cast(j as bigint), 32) | (shiftrightunsigned(fp, if(j < 32, 0, 32)) & 4294967295L & ~shiftleft(1L, j % 32))"


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of fingerprints within radius of each other."""
    u = fps.view(np.uint64)
    todo, out = np.arange(len(u)), []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            at, front = front[0], front[1:]
            near = np.bitwise_count(u[todo] ^ u[at]) <= radius
            if near.any():
                out += [(int(fps[at]), int(fps[x])) for x in todo[near]]
                front, todo = np.concatenate([front, todo[near]]), todo[~near]
    return out


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = [x for fps in batch.column(0) for x in forest(fps.values.to_numpy(zero_copy_only=False).astype(np.int64), RADIUS)]
        yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b), of which the components are those of all pairs within two bits."""
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).select("fp", F.expr(_VARIANT).alias("key"))
    met = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "met")
    links = met.where("n = 2").select("a", "b").where(f"bit_count(a ^ b) <= {RADIUS}")
    n = met.agg(F.sum(F.expr(f"if(n between 3 and {BUCKET}, 1, 0)")), F.sum(F.expr(f"if(n > {BUCKET}, 1, 0)"))).first()
    if n[0]:
        warm = keyed.join(met.where(f"n between 3 and {BUCKET}").select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
        links = links.unionByName(warm.select("fps").mapInArrow(_forests, "a long, b long"))
    if n[1]:
        hot = keyed.join(met.where(f"n > {BUCKET}").select("key"), "key").select("fp").distinct()
        two = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
        left = two.select("fp", F.expr("i * 64 + j").alias("ij"), F.expr("fp & ~shiftleft(1L, i) & ~shiftleft(1L, j)").alias("rest"))
        four = left.groupBy("ij", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        links = links.unionByName(four.select("a", F.explode("fps").alias("b")).where("a <> b"))
    out = written(links.distinct(), "links")
    drop_written(met)
    return out


def link_documents(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, and component_id, the least doc_id that links reach."""
    ship(docs.sparkSession)
    rows = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(k), "doc_id long, fp long"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(fingerprint_links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("node").alias("component_id"))
    return rows.join(written(placed.join(least, "root").select("fp", "component_id"), "placed"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

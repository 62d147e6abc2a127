"""Near-duplicate documents by deletion-variant signatures, at an exact similarity of their sets of five-word shingles.

Signature: SLOTS min-wise samples of a text's shingle hashes, cut into SEGMENTS segments of WIDTH slots. Each segment is indexed under its WIDTH
variants with one slot left out, so two texts of which some segment differs in at most one slot meet by an equality join, and are verified.

Why the slots are min-wise samples and not SimHash majority bits: of two texts of similarity 0.8 the majority bits differ in 0.15, and so a segment with at
most one different bit is either short (20 bits: 240 variants a text for 0.9 of such pairs, and every bucket grows with the corpus) or rare.
Slots differ in 0.2 but hold 64 bits each, so six equal ones are no chance, in a corpus of any size. A pair of similarity s shares a variant
of a segment with probability p = s^7 + 7 (1 - s) s^6, and of some segment with 1 - (1 - p)^7: 0.9976 at 0.8, 0.9998 at 0.85, whatever the edits are.

Verification: a bucket links its texts to its least one; connected texts are a cluster, and every text that has a partner is sent to its cluster's group
once. A kernel compares the exact shingle sets there and gives a spanning forest of the similar pairs. Clusters over WEIGHT shingles are dealt
out in chunks, each with the cluster's most central texts, which join nearly all copies of one text; texts that are still outside of the cluster's largest
component are then held against all others in a grid of blocks. So no group is gathered in a task, no pair is left out, and what
is shipped grows with the outsiders, not with the square of a group.

Texts are told apart by 128 bits. Defined results: null is the empty text, and all texts without words are alike; of texts with fewer than five words the
whole sequence is the one shingle; repeated rows and equal texts are one text, the row of the least doc_id (null last) stays, once; every column of the
documents is kept as it is, whatever its name; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.components import components
from readloom.llm.hashing import SEED, WordHashes, mixed, runs, small
from readloom.session import drop_written, ship, written

WIDTH = SEGMENTS = 7
SLOTS = WIDTH * SEGMENTS
WEIGHT = 1 << 19
MEMBERS = 512
LEADERS = 16

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, SLOTS, np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_SALTS = _rng.integers(0, 1 << 63, SLOTS, np.int64).astype(np.uint64)


def shingle_set(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """The distinct 64-bit hashes of a text's k-word shingles, sorted; of one without words, one hash, so that such texts are alike."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(runs(known.of(words), min(k, len(words)))) if words else np.zeros(1, np.uint64)


def slots(own: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of SLOTS orders."""
    out = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(own), 2048):
        out = np.minimum(out, (own[low : low + 2048, None] * _FACTORS).min(axis=0))
    return out


def variants(sample: np.ndarray) -> np.ndarray:
    """One key for each slot: its segment without it."""
    each = mixed(sample + _SALTS).reshape(SEGMENTS, WIDTH)
    return mixed((each.sum(axis=1, dtype=np.uint64)[:, None] - each).reshape(-1) ^ _SALTS).view(np.int64)


SIGNED = "h1 long, h2 long, no boolean, doc long, size long, keys array<long>"


def _signed(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = WordHashes(), {}
        for batch in small(batches):
            sizes, keys = [], []
            for h1, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if (h1, h2) not in last:
                    if len(last) > 1000:
                        last.clear()
                    own = shingle_set(text, k, known)
                    last[h1, h2] = len(own), variants(slots(own))
                sizes.append(last[h1, h2][0])
                keys.append(last[h1, h2][1])
            offsets = pa.array(np.arange(0, SLOTS * (len(keys) + 1), SLOTS, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(sizes, pa.int64()), lists], names=[x.split()[0] for x in SIGNED.split(", ")])

    return run


LEADER, TURN, MET, MAIN = range(4)


def forest(ids: np.ndarray, roots: np.ndarray, kinds: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the similar pairs of which one has a turn: rows by kind, leaders and turns first, then those that turns meet.

    What is of the main component needs no turn, as the others' turns meet it. It is that of the rows of kind MAIN; if all have turns, the largest after
    those of leaders. Rows of one root are together already."""
    size = np.array([len(x) for x in sets], np.int64)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(place, kind="stable")]
    ends, parts = np.cumsum(count), np.split(place, np.cumsum(size)[:-1])
    _, top = np.unique(roots, return_inverse=True)  # of each row its component
    links: list[tuple[int, int]] = []
    main = int(top[kinds == MAIN][0]) if (kinds == MAIN).any() else -1
    leaders = max(1, int((kinds == LEADER).sum())) if (kinds <= TURN).all() else -1
    for i in range(int((kinds <= TURN).sum())):
        if i == leaders:
            main = int(np.bincount(top).argmax())
        if top[i] == main:
            continue
        own = parts[i][count[parts[i]] > 1]
        if len(own):
            n = np.bincount(np.concatenate([owner[ends[t] - count[t] : ends[t]] for t in own.tolist()]), minlength=len(sets))
            for j in np.flatnonzero((n >= similarity * (size[i] + size - n) - 1e-9) & (top != top[i])).tolist():
                if top[i] != top[j]:
                    links.append((int(ids[i]), int(ids[j])))
                    keep, gone = (top[j], top[i]) if top[j] == main else (top[i], top[j])
                    top[top == gone] = keep
    return links


def _groups(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[list[tuple]]:
    """Rows, sorted by their first n columns, in groups of equal ones."""
    held: list[tuple] = []
    for batch in small(batches, 128):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:n] != row[:n]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


GROUPED = ("cluster", "x", "y", "kind", "uid", "root", "text")


def _compared(k: int, similarity: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of GROUPED, sorted, to the links (a, b) of each group."""
        known = WordHashes()
        for rows in _groups(batches, 3):
            seen: dict[int, tuple] = {}
            for r in rows:
                seen.setdefault(r[4], r)
            rows = list(seen.values())
            kinds, ids, roots = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5))
            links = forest(ids, roots, kinds, [shingle_set(r[6], k, known) for r in rows], similarity) if len(rows) > 1 else []
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _identified(docs: DataFrame) -> list:
    """Columns that tell the rows of docs apart: 128 bits of the text, and the doc_id."""
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(SEED), text).alias("h2"), doc.isNull().alias("no"), F.coalesce(doc, F.lit(0)).alias("doc")]


KEY = ["h1", "h2", "no", "doc"]


def text_nodes(docs: DataFrame, k: int) -> DataFrame:
    """One row of each distinct text: uid, h1, h2, the least document (no, doc), its number of shingles and its variants' keys."""
    signed = docs.select(*_identified(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_signed(k), SIGNED)
    least = signed.groupBy("h1", "h2").agg(F.min(F.struct("no", "doc", "size", "keys")).alias("m"))
    return written(least.select(F.monotonically_increasing_id().alias("uid"), "h1", "h2", "m.*"), "nodes")


def text_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): distinct texts, and (node, root) of those that have near duplicates and are not their group's root."""
    ship(docs.sparkSession)
    nodes = text_nodes(docs, k)
    keyed = nodes.select("uid", F.explode("keys").alias("key"))
    met = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("uid").alias("least")).where("n > 1"), "met")
    members = written(keyed.join(met, "key"), "members")  # two plain sides: a key of very many texts is split
    drop_written(met)
    clusters = components(members.select(F.col("uid").alias("a"), F.col("least").alias("b")))
    placed = clusters.select(F.col("node").alias("uid"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("uid"), F.col("root").alias("cluster")).distinct())
    central = members.groupBy("uid").agg(F.sum("n").alias("central"))
    own = written(placed.join(nodes.select("uid", "size", *KEY), "uid").join(central, "uid"), "clustered")
    drop_written(members)
    weighed = written(own.groupBy("cluster").agg(F.sum("size").alias("weight"), F.count("*").alias("n")), "weighed")
    chunks = F.greatest(F.ceil(F.col("weight") / WEIGHT), F.ceil(F.col("n") / MEMBERS)).cast("int")
    need = own.join(weighed.select("cluster", chunks.alias("chunks")), "cluster")
    plain = docs.select(*_identified(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = written(plain.join(need.select(*KEY, "uid", "cluster", "chunks", "central", "size"), KEY).dropDuplicates(KEY).drop(*KEY), "held")
    drop_written(own)
    drop_written(weighed)

    def linked(grid: DataFrame) -> DataFrame:
        dealt = grid.select(*GROUPED).repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "kind", "uid")
        return dealt.mapInArrow(_compared(k, similarity), "a long, b long").distinct()

    slices = held.groupBy("cluster", F.pmod(F.xxhash64("uid"), F.lit(LEADERS)).alias("s"))
    leaders = slices.agg(F.max(F.struct("central", "uid")).alias("m")).where("m.uid is not null").select(F.col("m.uid").alias("uid"))
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_to = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    alone = lambda x, kind: ["cluster", x.alias("x"), F.lit(0).alias("y"), F.lit(kind).alias("kind"), "uid", F.col("uid").alias("root"), "text"]
    heads = held.where("chunks > 1").join(leaders, "uid", "left_semi").select(*alone(over("chunks"), LEADER))
    links = written(linked(held.select(*alone(dealt_to("chunks"), TURN)).unionByName(heads)), "near")
    roots = components(links)
    large = held.where("chunks > 1").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    kinds = large.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    most = kinds.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots"), F.sum("weight").alias("all"), F.sum("n").alias("n")).where("roots > 1")
    least = most.join(kinds.withColumnRenamed("n", "own"), "cluster").where("root <> m.root").groupBy("cluster").agg(F.sum("weight").alias("weight"), F.sum("own").alias("own"))
    blocks = lambda w, n: F.greatest(F.ceil(F.col(w) / WEIGHT), F.ceil(F.col(n) / MEMBERS), F.lit(1)).cast("int")
    sized = written(most.join(least, "cluster").select("cluster", F.col("m.root").alias("main"), blocks("all", "n").alias("cols"), blocks("weight", "own").alias("rows")), "sized")
    if not sized.isEmpty():
        left = large.join(sized, "cluster")
        out = left.where("root <> main").select("cluster", dealt_to("rows").alias("x"), over("cols").alias("y"), F.lit(TURN).alias("kind"), "uid", "root", "text")
        met_by = left.withColumn("kind", F.when(F.col("root") == F.col("main"), MAIN).otherwise(MET))
        other = met_by.select("cluster", over("rows").alias("x"), dealt_to("cols").alias("y"), "kind", "uid", "root", "text")
        more = written(linked(out.unionByName(other)), "near")
        drop_written(roots)
        roots = components(links.unionByName(more))
        drop_written(more)
    for x in (clusters, links, held, sized):
        drop_written(x)
    return nodes, roots


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of equal or near-duplicate texts: that of the least doc_id (null last)."""
    nodes, roots = text_groups(docs, k, similarity)
    placed = nodes.select("uid", *KEY).join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    kept = written(placed.groupBy("root").agg(F.min(F.struct("no", "doc", "h1", "h2")).alias("m")).select("m.*"), "kept")
    drop_written(nodes)
    drop_written(roots)
    rows = docs.select(F.struct("*").alias("row"), *_identified(docs))
    return rows.join(kept, KEY, "left_semi").dropDuplicates(KEY).select("row.*")

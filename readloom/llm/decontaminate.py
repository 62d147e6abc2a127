"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index of Hamming blocks, exact weighted-shingle similarity.

Every window of a document that has as many words as some item gets a fingerprint of 128 bits over its five-word shingles (repeats weigh); of a text with
fewer words than the item it is the whole text. Sums of bits are kept bit-sliced: the binary digits of 64 counters are 64-bit words, so a window one
shingle longer costs a few word operations, whatever the number of windows. A window without any shingle of an item has similarity 0: stretches of text that
are further than an item's size from every such shingle are left out before, and with them no candidate.

Multi-index: a fingerprint is cut into eight blocks of 16 bits. Of two fingerprints within RADIUS = 34 bits some block differs in at most as many bits
as NEAR allows it (3 + 5 * 7 - 1 = 34: more in every block would be over RADIUS), so tables of all values that near an item's block, one look-up a
block, find every fingerprint within the radius. A random one meets 0.17 of the items; their distances are then counted. At a similarity of 0.8 fingerprints
differ in 19.4 bits on average, with a deviation of 4.1: more than RADIUS in 2 of 10,000.

Candidates are verified exactly: the weighted Jaccard similarity of the shingle multisets is at least 0.8.

The benchmark is the stated query set. It is processed in blocks of at most BLOCK_BYTES of text and BLOCK_ITEMS items or so, each broadcast; a benchmark of
any size makes more blocks, not larger ones.

Defined results: items and texts that are null or have no words never match; items of fewer than five words are one shingle, and so is a shorter text;
repeated rows and items give repeated pairs; of windows that are equally similar the first is told; null ids are kept; other columns are kept or not read, whatever
their names.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.hashing import WordHashes, mixed, runs, small
from readloom.session import ship

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 34
NEAR = (4, 4, 4, 3, 3, 3, 3, 3)
BLOCK_BYTES = 8 << 20
BLOCK_ITEMS = 4096
CHUNK = 6000


def normal(text: str | None) -> list[bytes]:
    """Lower-cased words, cut at ASCII white space alone."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes], k: int = SHINGLE) -> list[bytes]:
    if not words:
        return []
    k = min(k, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Of shingle multisets: each shingle weighs as often as it occurs."""
    common = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


# ---- fingerprints -----------------------------------------------------------------------------


def lanes(h: np.ndarray) -> np.ndarray:
    """128 bits of each shingle, as two rows of 64-bit words."""
    return np.stack([h, mixed(h ^ np.uint64(0x9E3779B97F4A7C15))])


def _more(planes: list[np.ndarray], bits: np.ndarray, n: int) -> None:
    """Add one bit to each of the first n counters, in place."""
    for p in planes:
        p = p[:, :n]
        carry = p & bits
        p ^= bits
        bits = carry
    planes.append(np.zeros_like(planes[0]))
    planes[-1][:, :n] = bits


def _over(planes: list[np.ndarray], n: int, limit: int) -> np.ndarray:
    """Of the first n counters the bits that are set where the count is over limit: the carry out of count + 2^planes - 1 - limit."""
    rest, out = (1 << len(planes)) - 1 - limit, np.zeros_like(planes[0][:, :n])
    for b, p in enumerate(planes):
        out = p[:, :n] | out if rest >> b & 1 else p[:, :n] & out
    return out


def fingerprints(bits: np.ndarray, numbers: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(m, fingerprints of all windows of m shingles) of each m, ascending; a bit is set if it is in over half of the m."""
    planes, have = [bits.copy()], 1
    for m in numbers:
        if m > bits.shape[1]:
            return
        for have in range(have + 1, m + 1):  # noqa: B020
            _more(planes, bits[:, have - 1 :], bits.shape[1] - have + 1)
            if have < 1 << (len(planes) - 1):
                planes.pop()
        yield m, _over(planes, bits.shape[1] - m + 1, m // 2)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """Of one whole run of shingles."""
    return next(fingerprints(lanes(h), [len(h)]))[1][:, 0]


def _patterns(bits: int) -> np.ndarray:
    return np.array([sum(1 << b for b in some) for n in range(bits + 1) for some in itertools.combinations(range(16), n)], np.uint16)


_PATTERNS = {n: _patterns(n) for n in set(NEAR)}


class Group:
    """A multi-index of up to 64 fingerprints: for each block a table of the items that its values are near to."""

    def __init__(self, numbers: list[int], fps: list[np.ndarray]):
        self.numbers, self.fps = numbers, fps
        kind = next(np.dtype(f"u{w}") for w in (1, 2, 4, 8) if len(fps) <= 8 * w)
        self.tables = np.zeros((len(NEAR), 1 << 16), kind)
        for i, fp in enumerate(fps):
            for block, value in enumerate(fp.view(np.uint16)):
                self.tables[block][value ^ _PATTERNS[NEAR[block]]] |= kind.type(1 << i)

    def find(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places of the fingerprints within RADIUS of it)."""
        cut = np.ascontiguousarray(fps).view(np.uint16).reshape(2, -1, 4)
        met = np.zeros(fps.shape[1], self.tables.dtype)
        for block, table in enumerate(self.tables):
            met |= table.take(cut[block // 4, :, block % 4].astype(np.intp))
        at = np.flatnonzero(met)
        if len(at):
            met, fps = met[at], fps[:, at]
            for i, fp in enumerate(self.fps):
                own = np.flatnonzero(met & met.dtype.type(1 << i))
                near = own[np.bitwise_count(fps[:, own] ^ fp[:, None]).sum(axis=0, dtype=np.int64) <= RADIUS]
                if len(near):
                    yield self.numbers[i], at[near]


class Known:
    """A set of hashes, asked for many at once."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.uint64((1 << max(12, 5 + len(self.sorted).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(self.sorted & self.mask).astype(np.intp)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits.take((h & self.mask).astype(np.intp)))
        return at[self.sorted.take(np.searchsorted(self.sorted, h[at]), mode="clip") == h[at]]


class Items:
    """A block of items, indexed by their number of words."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.known, self.items = WordHashes(), []
        sizes, hashes = defaultdict(list), defaultdict(list)
        for item_id, text in items:
            if words := normal(text):
                sizes[len(words)].append(len(self.items))
                k = min(SHINGLE, len(words))
                h = runs(self.known.of(words), k)
                hashes[k].append(h)
                self.items.append((item_id, len(words), Counter(shingles(words)), fingerprint(h)))
        of = lambda some: [self.items[x][3] for x in some]
        self.sizes = {n: [Group(own[i : i + 64], of(own[i : i + 64])) for i in range(0, len(own), 64)] for n, own in sorted(sizes.items())}
        self.shingles = {k: Known(np.concatenate(x)) for k, x in hashes.items()}

    def candidates(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, item, first word) of the windows whose fingerprints are within RADIUS of an item's."""
        size = np.array([len(x) for x in texts])
        starts = np.cumsum(size) - size
        words = self.known.of(list(itertools.chain.from_iterable(texts)))
        owner = np.repeat(np.arange(len(texts)), size)
        for k, shingles_of in self.shingles.items():
            h, sizes = runs(words, k), [n for n in self.sizes if min(n, SHINGLE) == k]
            own = owner[: len(h)]
            at = shingles_of.places(h)
            at = at[owner[at + k - 1] == own[at]]
            if not len(at):
                continue
            low, high = np.maximum(at + k - sizes[-1], starts[own[at]]), np.minimum(at + sizes[-1], (starts + size)[own[at]])
            new = np.flatnonzero((low[1:] > high[:-1]) | (own[at[1:]] != own[at[:-1]])) + 1
            low, high = low[np.concatenate([[0], new])], high[np.concatenate([new - 1, [len(at) - 1]])]
            place = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            left = np.repeat(high, high - low) - place  # words from each one to its stretch's end
            for m, fps in fingerprints(lanes(runs(words[place], k)), [n - k + 1 for n in sizes]):
                for group in self.sizes[m + k - 1]:
                    for item, found in group.find(fps):
                        for i in place[found[left[found] >= m + k - 1]].tolist():
                            yield int(owner[i]), item, i - int(starts[owner[i]])
            for i in set(own[at].tolist()) if k == SHINGLE else ():
                if longer := [n for n in sizes if size[i] < n and size[i] - k + 1 >= SIMILARITY * (n - k + 1)]:
                    fp = fingerprint(h[starts[i] : starts[i] + size[i] - k + 1])[:, None]
                    for group in itertools.chain.from_iterable(self.sizes[n] for n in longer):
                        for item, _ in group.find(fp):
                            yield i, item, 0

    def search(self, texts: list[str | None]) -> Iterator[list[tuple[int | None, float, int, int]]]:
        """Of each text (item, best similarity, its first word, windows) of each item that some window matches."""
        held: list[list[bytes]] = []
        for text in texts:
            held.append(normal(text))
            if sum(map(len, held)) >= CHUNK:
                yield from self._verified(held)
                held = []
        yield from self._verified(held)

    def _verified(self, texts: list[list[bytes]]) -> Iterator[list[tuple[int | None, float, int, int]]]:
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        for i, x, first in self.candidates(texts) if self.items and any(texts) else ():
            _, n, grams, _ = self.items[x]
            score = weighted_jaccard(grams, Counter(shingles(texts[i][first : first + n])))
            if score >= SIMILARITY:
                top, where, count = best[i].get(x, (0.0, 0, 0))
                best[i][x] = (score, first, count + 1) if score > top else (top, where, count + 1)
        for found in best:
            yield sorted(((self.items[x][0], s, w, c) for x, (s, w, c) in found.items()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))

    def find(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        return next(self.search([text]))


_built: dict[str, Items] = {}


def _index(shared) -> Items:
    key, items = shared.value
    if key not in _built:
        _built.clear()
        _built[key] = Items(items)
    return _built[key]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about BLOCK_BYTES of text and BLOCK_ITEMS, dealt by hash; one block is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = 1 + max(total // BLOCK_BYTES, count // BLOCK_ITEMS)
    for b in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


MATCH = "doc_id long, item_id long, similarity double, first_word long, n_windows long"


def _finder(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for batch in small(batches):
            rows = [(d, *x) for d, found in zip(batch.column(0).to_pylist(), index.search(batch.column(1).to_pylist()), strict=True) for x in found]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in MATCH.split(", ")])

    return run


def _share(spark, items: list):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, items))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_windows) of every document and item of which a window matches."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = [plain.mapInArrow(_finder(_share(docs.sparkSession, items)), MATCH) for items in item_blocks(benchmark)]
    return reduce(DataFrame.unionByName, found)


def _cleaner(shared, at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for batch in small(batches):
            yield batch.filter(pa.array([not found for found in index.search(batch.column(at).to_pylist())], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those of which a window matches an item; all columns as they were."""
    ship(docs.sparkSession)
    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(_cleaner(_share(docs.sparkSession, items), docs.columns.index("text")), docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

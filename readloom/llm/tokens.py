"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A shard is two files in the shared folder. `shard-NNNNN.ids` is the raw payload: the ids of its documents one after
another, little-endian, two bytes each where the vocabulary allows it, else four. `shard-NNNNN.idx` has a JSON line (counts,
width) and arrays: displacements of a hash-and-displace minimal perfect hash, the first row and a 32-bit fingerprint of each
slot, the offsets of the rows in ids, and the keys. Looking up a key reads one displacement, one slot and one offset.

Documents go to shards by ranges of doc_id (nulls first); rows that share a doc_id follow each other, by the hash of
their text, and one such group may span shards. A task writes to names of its own attempt and renames at its end, so a task that runs again
leaves the same files.

Defined results: a null text is the empty one (only the end id); repeated rows each have their ids; no documents, no shards.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readloom.session import new_folder, ship

TOKENIZER = "byte_bpe_50k.json"
END = 0
CACHED_PIECES = 250_000

# ---- encoding ---------------------------------------------------------------------------------

#: No visible character, or none to some engine: between two of them a space is no piece boundary.
_ODD = re.compile("[^\x21-\x7e\xa1-\xac\xae-\u024f]")
#: Fixed value: how the byte-level tokenizers split texts before they merge.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, "Encoder"] = {}


def byte_alphabet() -> dict[int, int]:
    """The characters by which byte-level vocabularies write bytes: visible Latin-1 ones stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as bytes of the given width, by the tokenizers library, with a memory of pieces.

    A space with a visible character on either side starts a pre-token, and nothing merges across pre-tokens. So a text is cut at
    such spaces, a piece that is known gives its ids at once, and a new one is split into pre-tokens, of which the
    library's model encodes those not seen before. Pieces with rare characters, and texts with runs of white space, go
    through the whole library, whose own rules then hold."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        told = json.loads(self.tokenizer.to_str())
        pre = told.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer")
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.alphabet, self.pattern = byte_alphabet(), regex.compile(PRETOKEN)
        self.pieces: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _pretoken(self, x: str) -> bytes:
        if (ids := self.pretokens.get(x)) is None:
            ids = self._merged(x.encode().decode("latin1").translate(self.alphabet))
            if len(self.pretokens) < CACHED_PIECES // 8 and len(x) < 48:
                self.pretokens[x] = ids
        return ids

    def _merged(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word of letters."""
        if (ids := self.pieces.get(word)) is None:
            ids = self._merged("\u0120" + word if word.isascii() else "\u0120" + word.encode().decode("latin1").translate(self.alphabet))
            if len(self.pieces) < CACHED_PIECES and len(word) < 48:
                self.pieces[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a space and a piece; None if the space before or after it may be no boundary."""
        if piece.isalpha() and (piece.isascii() or max(piece) < "\u0250"):
            return self._word(piece)
        if piece[-1:] in (",", ".") and (word := piece[:-1]).isalpha() and (word.isascii() or max(word) < "\u0250"):
            ids = self._word(word) + self._pretoken(piece[-1])
        elif not piece or _ODD.match(piece) or _ODD.match(piece[-1]):
            return None
        elif _ODD.search(piece.replace("\n", "")):
            return self._whole(" " + piece)
        else:
            ids = b"".join(map(self._pretoken, self.pattern.findall(" " + piece)))
        if len(self.pieces) < CACHED_PIECES // 3 and len(piece) < 48:
            self.pieces[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain or any(x in text for x in self.special):
            return self._whole(text)
        first, *parts = text.split(" ")
        out = list(map(self.pieces.get, parts))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = ids = self._piece(parts[i])
                    if ids is None:
                        return self._whole(text)
        if not first or _ODD.search(first):
            if parts and (not first or _ODD.match(first[-1])):
                return self._whole(text)
            return self._whole(first) + b"".join(out)
        return b"".join(map(self._pretoken, self.pattern.findall(first))) + b"".join(out)

    def batch(self, texts: list[str]) -> list[bytes]:
        return list(map(self.text, texts))


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


# ---- minimal perfect hash ---------------------------------------------------------------------

_M1, _M2, _NULL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hashes(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hashes of int64 keys; a null key has a hash of its own."""
    with np.errstate(over="ignore"):
        return _mix(_mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ np.where(null, _NULL, np.uint64(0)))


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h ^ (d.astype(np.uint64) * _NULL)) % np.uint64(n)


def build(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct hashes: a number for each bucket of about four; a negative one names the slot of a single key."""
    n = len(h)
    m = n // 4 + 1
    shift = np.zeros(m, np.int64)
    bucket = (h % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(m + 1))
    sizes = np.diff(starts)
    taken = np.zeros(n, bool)
    tries = np.arange(32, dtype=np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        own = h[order[starts[b] : starts[b + 1]]]
        if len(own) < 2:
            break
        at = 0
        while True:
            slots = _slot(own[None, :], (tries + at)[:, None], n).astype(np.int64)
            good = ~taken[slots].any(axis=1)
            good &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
            if good.any():
                k = int(good.argmax())
                shift[b], taken[slots[k]] = at + k, True
                break
            at += len(tries)
    free = iter(np.flatnonzero(~taken))
    for b in np.flatnonzero(sizes == 1):
        shift[b] = -1 - next(free)
    return shift


def lookup(shift: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Slots of hashes. A hash that was not built in gets some slot; the fingerprint tells."""
    d = shift[(h % np.uint64(len(shift))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _slot(h, np.maximum(d, 0), max(n, 1)).astype(np.int64))


# ---- shards -----------------------------------------------------------------------------------


class Shard:
    """A shard's index, read from its file, with keyed access to its payload."""

    def __init__(self, fs: pa.fs.FileSystem, stem: str):
        self.fs, self.stem = fs, stem
        with fs.open_input_stream(f"{stem}.idx") as f:
            raw = f.read()
        head, _, body = raw.partition(b"\n")
        head = json.loads(head)
        self.width, rows, keys, m = head["width"], head["rows"], head["keys"], head["buckets"]
        at = 0

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.shift, self.offsets, self.keys = take("<i8", m), take("<u8", rows + 1), take("<i8", rows)
        self.first, self.mark, self.null = take("<u4", keys), take("<u4", keys), take("u1", rows)

    def find(self, key: int | None) -> range:
        """Rows of a key."""
        n = len(self.first)
        if not n:
            return range(0)
        h = hashes(np.array([key or 0]), np.array([key is None]))
        slot = int(lookup(self.shift, h, n)[0])
        if self.mark[slot] != np.uint32(h[0] >> np.uint64(32)):
            return range(0)
        row = end = int(self.first[slot])
        while end < len(self.keys) and bool(self.null[end]) == (key is None) and (key is None or self.keys[end] == key):
            end += 1
        return range(row, end)

    def payload(self) -> np.ndarray:
        with self.fs.open_input_stream(f"{self.stem}.ids") as f:
            return np.frombuffer(f.read(), f"<u{self.width}")

    def get(self, key: int | None) -> list[np.ndarray]:
        """Ids of the documents with a key: one seek each."""
        out = []
        with self.fs.open_input_file(f"{self.stem}.ids") as f:
            for row in self.find(key):
                a, b = int(self.offsets[row]), int(self.offsets[row + 1])
                f.seek(a * self.width)
                out.append(np.frombuffer(f.read((b - a) * self.width), f"<u{self.width}"))
        return out


MANIFEST = "shard int, rows long, n_tokens long"


def _writer(folder: str, path: str | None, name: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or public_tokenizers.path(name))
        fs, root = pa.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        shard, stem = context.partitionId(), f"{root}/shard-{context.partitionId():05d}"
        own, end = f"{stem}.attempt-{context.taskAttemptId()}", np.array([END], enc.type).tobytes()
        keys, null, counts, out = [], [], [], None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{own}.ids")
                ids = [x + end for x in enc.batch([t or "" for t in part.column(1).to_pylist()])]
                out.write(b"".join(ids))
                counts += [len(x) // enc.type.itemsize for x in ids]
                keys += [k or 0 for k in part.column(0).to_pylist()]
                null += part.column(0).is_null().to_pylist()
        if out is None:
            return
        out.close()
        key, is_null = np.array(keys, np.int64), np.array(null, bool)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (is_null[1:] != is_null[:-1])
        rows = np.flatnonzero(new)
        h = hashes(key[rows], is_null[rows])
        shift = build(h)
        slots = lookup(shift, h, len(h))
        first, mark = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u4")
        first[slots], mark[slots] = rows, (h >> np.uint64(32)).astype(np.uint32)
        head = {"width": enc.type.itemsize, "rows": len(key), "keys": len(h), "buckets": len(shift)}
        with fs.open_output_stream(f"{own}.idx") as f:
            f.write(json.dumps(head).encode() + b"\n" + b"".join(x.tobytes() for x in (shift.astype("<i8"), offsets, key.astype("<i8"), first, mark, is_null.astype("u1"))))
        for kind in ("ids", "idx"):
            fs.move(f"{own}.{kind}", f"{stem}.{kind}")
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], names=["shard", "rows", "n_tokens"])

    return write


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, name: str = TOKENIZER, shards: int | None = None) -> list[tuple[int, int, int]]:
    """Write the shards of docs (doc_id, text); the manifest: (shard, rows, ids before it) in order, a few numbers for each shard."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = shards or max(1, docs.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("text")]
    dealt = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    out, before = [], 0
    for r in sorted(dealt.mapInArrow(_writer(folder, path, name), MANIFEST).collect()):
        out.append((r["shard"], r["rows"], before))
        before += r["n_tokens"]
    return out


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def _reader(folder: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(fs, f"{root}/shard-{shard:05d}")
                ids = s.payload()
                null = s.null.astype(bool)
                slots = lookup(s.shift, hashes(s.keys, null), len(s.first))
                again = s.first[slots].astype(np.int64)
                if (s.keys[again] != s.keys).any() or (null[again] != null).any():
                    raise ValueError(f"shard {shard}: the index does not find its keys")
                bounds = s.offsets.astype(np.int64)
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(s.keys, pa.int64(), mask=null), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), pa.array(np.full(len(sums), shard, np.int32))], names=[x.split()[0] for x in ROWS.split(", ")])

    return read


def read_tokens(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """One row per document, from the files alone: key, place among all ids, number and checksum of its ids. A task reads one shard."""
    table = spark.createDataFrame(spark.sparkContext.parallelize([(s, b) for s, _, b in manifest], max(1, len(manifest))), "shard int, before long")
    return table.mapInArrow(_reader(folder), ROWS)


def token_rows(docs: DataFrame, path: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """docs encoded, written as shards into the shared folder, and read back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, path, name))


def op4_token_binary(spark, sf_dir: str) -> DataFrame:
    return token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))

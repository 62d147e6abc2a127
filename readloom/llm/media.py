"""Media columns: HTML pages become ordered sequences of text and media references, payloads resolve by digest.

`parse` walks a page once and yields items in reading order: text runs, and media references with the
caption that belongs to them (figcaption, before or after them, else alt); the caption of a figure without media is text. A payload table is keyed by the sha256 of the payload; an
equality join on that digest resolves references, so positions and captions never move.

Stored form: an 8-bit grey PNG, 64 samples a row, one row for each 64 bytes of the padded payload. It is lossless,
and `decode` returns the payload's bytes.

Defined results: a null text is the empty one; its payload is 64 zero bytes. Null html gives an empty sequence.
A reference without a payload keeps its place with null payload columns. Repeated rows give repeated rows; other columns are kept by `interleave` (not one named
items, n_items or digest) and not read else.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import drop_written, ship, written

WIDTH = 64
SKIPPED = frozenset({"script", "style", "noscript", "template"})
BLOCKS = frozenset({"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "article", "section", "header", "footer", "nav", "title", "figure", "figcaption", "blockquote", "pre"})
ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 1) -> bytes:
    """The payload (a positive multiple of 64 bytes) as an 8-bit grey PNG."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of a PNG that `encode` wrote; checks signature, chunk sums and size."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's sum is wrong")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter type other than 0")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Size, mean, variance and entropy of the samples in thousandths, and the sum of differences of neighbours: integers, so the same everywhere."""
    x = np.frombuffer(samples, np.uint8)
    n, counts = len(x), np.bincount(x, minlength=256).astype(np.int64)
    values = np.arange(256, dtype=np.int64)
    total, square = int((counts * values).sum()), int((counts * values * values).sum())
    p = counts[counts > 0] / n
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"{WIDTH}x{n // WIDTH};mean={total * 1000 // n};var={(square * n - total * total) * 1000 // (n * n)};entropy={round(float(-(p * np.log2(p)).sum()) * 1000)};step={steps}"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.skip, self.figure = [], [], 0, []

    def flush(self):
        if text := " ".join("".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.words = []

    def close_caption(self):
        """An ended caption holds its place as text until its figure closes."""
        own = self.figure[-1]
        if text := " ".join("".join(own["open"] or ()).split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
            own["captions"].append(self.items[-1])
        own["open"] = None

    def close_figure(self):
        self.close_caption()
        own = self.figure.pop()
        if own["media"] and own["captions"]:
            text = " ".join(x["text"] for x in own["captions"])
            for x in own["media"]:
                x["caption"] = text
            for x in own["captions"]:
                x["kind"] = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure.append({"media": [], "captions": [], "open": None})
        elif tag == "figcaption" and self.figure:
            self.close_caption()
            self.figure[-1]["open"] = []
        elif tag in ("img", "video", "audio", "source", "embed"):
            own = dict(attrs)
            if ref := own.get("src"):
                self.flush()
                self.items.append({"kind": "media", "text": None, "ref": ref, "caption": own.get("alt") or None})
                if self.figure:
                    self.figure[-1]["media"].append(self.items[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED:
            self.skip -= 1

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption" and self.figure:
            self.close_caption()
        elif tag == "figure" and self.figure:
            self.close_figure()

    def handle_data(self, data):
        if not self.skip:
            caption = self.figure[-1]["open"] if self.figure else None
            (self.words if caption is None else caption).append(data)


def parse(page: str | None) -> list[dict]:
    """Items of a page in reading order, with their positions; a caption is kept with its figure's media, as text if there are none."""
    if not page:
        return []
    parser = _Sequence()
    parser.feed(page)
    parser.close()
    parser.flush()
    while parser.figure:
        parser.close_figure()
    return [{"pos": i, **x} for i, x in enumerate(x for x in parser.items if x["kind"])]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def page_of(text: str | None, digest: str, n_bytes: int) -> str:
    """A document as a page: its lines as paragraphs, and between them the figure that refers to its payload."""
    lines = [f"<p>{html.escape(x)}</p>" for x in (text or "").split("\n")]
    figure = f'<figure><img src="sha256:{digest}" alt="payload"><figcaption>{n_bytes} bytes</figcaption></figure>'
    half = len(lines) // 2
    return f"<article>{''.join(lines[:half])}{figure}{''.join(lines[half:])}</article>"


_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def _parse(at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([parse(x) for x in batch.column(at).to_pylist()], pa.list_(_ITEM))
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.record_batch([*(batch.column(i) for i in kept), items], names=[*(batch.schema.names[i] for i in kept), "items"])

    return run


def interleave(pages: DataFrame) -> DataFrame:
    """pages with `items`, the ordered text and media-reference structs of each page, in place of html; other columns are kept."""
    ship(pages.sparkSession)
    plain = pages.withColumn("html", F.col("html").cast("string"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "html")
    return plain.mapInArrow(_parse(plain.columns.index("html")), f"{kept}, items array<{ITEM}>")


def exploded(sequences: DataFrame) -> DataFrame:
    """One row per item: the sequence's other columns, the item's fields, and the digest that a reference of the form `sha256:<digest>` names."""
    rows = sequences.select(*(c for c in sequences.columns if c != "items"), F.size("items").alias("n_items"), F.explode("items").alias("i"))
    return rows.select(*(c for c in rows.columns if c != "i"), "i.*").withColumn("digest", F.regexp_extract(F.coalesce("ref", F.lit("")), "^sha256:([0-9a-f]{64})$", 1))


def resolve(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """`exploded` items, in place, with the columns of the payload (a table unique in digest) that each refers to; no reference is lost, and text is not shuffled.

    Both sides of the join are plain, so that a digest of very many references is split."""
    media = items.where("kind = 'media'").join(payloads, "digest", "left")
    text = items.where("kind <> 'media'")
    return media.unionByName(text, allowMissingColumns=True)


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [padded((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([pa.array(list(map(_digest, payloads)), pa.string()), pa.array(list(map(encode, payloads)), pa.binary())], names=["digest", "media"])


def _document_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, items = [], []
        for text in batch.column(1).to_pylist():
            data = (text or "").encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            items.append(parse(page_of(text, _digest(padded(data)), len(data))))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(items, pa.list_(_ITEM))], names=["doc_id", "n_bytes", "items"])


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload = decode(media)
            rows.append((digest, len(payload), _digest(payload), zlib.crc32(payload[-WIDTH:]), len(media), _digest(media), feature(payload)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _plain(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def store_media(docs: DataFrame) -> DataFrame:
    """documents to the written media column: (digest, media), read back from the shared folder."""
    return written(_plain(docs).mapInArrow(_stored, "digest string, media binary"), "media", "none")


def media_features(stored: DataFrame) -> DataFrame:
    """Features of the stored bytes, one row per digest, written; only digests and features are shuffled, never payloads."""
    found = stored.mapInArrow(_features, FEATURES)
    return written(found.groupBy("digest").agg(*(F.min(c).alias(c) for c in found.columns if c != "digest")), "features")


def document_sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, items): each document as a page of its lines around the figure of its payload, parsed into an ordered sequence."""
    return _plain(docs).mapInArrow(_document_items, f"doc_id long, n_bytes long, items array<{ITEM}>")


def document_media(docs: DataFrame) -> DataFrame:
    """The media item of each document's sequence, in its place, with what its payload's stored form gives."""
    stored = store_media(docs)
    features = media_features(stored)
    drop_written(stored)
    items = exploded(document_sequences(docs)).where("kind = 'media'").drop("text")
    return resolve(items, features).select("doc_id", "n_bytes", *(x.split()[0] for x in FEATURES.split(", ")[1:]), "pos", "n_items", "caption")


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    return document_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def media_pages(spark, sf_dir: str) -> DataFrame:
    """The sequences of `pages`, one row per item; references are told, as that table brings no payloads."""
    items = exploded(interleave(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")))
    return items.select("page_id", "n_items", "pos", "kind", "text", "ref", "caption")

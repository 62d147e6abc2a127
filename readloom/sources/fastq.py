"""FASTQ: distributed scans of files and folders, a Python data source for one stream, and pairing of files and interleaved records.

`scan` reads through Spark's file systems (local, s3a, hdfs and others; folders and patterns too). Lines come in splits. A first pass tells of each split
where a record would end for each of the four places it may begin at, and its first three lines; from that follow, split after split, its first
record's number and what its last record lacks, so a second pass makes whole records without a shuffle. What the driver holds is a few numbers and
lines for each split. Gzip files of many small members with their sizes (BGZF) are split too; other compressed files are one task each.

Defined results: files follow each other by path, and records are numbered through; an empty file has none; blank lines are passed over where a name is expected and nowhere
else; anything else that is not four lines is an error that names the record, counted from 1 within its file.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.session import ship

SCHEMA = "ordinal long, name string, seq string, plus string, qual string"


class FastqError(ValueError):
    """Malformed input; the message names the record, counted from 1."""


def records(lines: Iterable[bytes], phred64: bool = False, first: int = 0) -> Iterator[tuple[int, str, str, str, str]]:
    """(ordinal, name, seq, plus, qual) of each record, numbered from first; blank lines are passed over where a name is expected, and nowhere else."""
    it, n = iter(lines), first
    low, high = (64, 126) if phred64 else (33, 126)
    for raw in it:
        name = raw.rstrip(b"\r\n")
        if not name.strip():
            continue
        rest = []
        for _ in range(3):
            line = next(it, None)
            if line is None:
                raise FastqError(f"record {n + 1}: truncated")
            rest.append(line.rstrip(b"\r\n"))
        seq, plus, qual = rest
        if not name.startswith(b"@"):
            raise FastqError(f"record {n + 1}: a name must start with @")
        if not plus.startswith(b"+"):
            raise FastqError(f"record {n + 1}: the separator must start with +")
        if len(seq) != len(qual):
            raise FastqError(f"record {n + 1}: {len(seq)} bases and {len(qual)} qualities")
        if qual and not (low <= min(qual) and max(qual) <= high):
            raise FastqError(f"record {n + 1}: a quality is out of range")
        if phred64:
            qual = bytes(q - 31 for q in qual)
        yield n, *(x.decode("latin-1") for x in (name, seq, plus, qual))
        n += 1


def open_lines(path: str):
    """Lines of a local, file: or http(s): path; gzip (also of several members) and zstd by magic bytes."""
    if path.startswith(("http://", "https://")):
        import urllib.request

        raw = io.BufferedReader(urllib.request.urlopen(path))  # noqa: S310
        head = raw.peek(4)[:4]
    else:
        raw = open(path.removeprefix("file://"), "rb")  # noqa: SIM115
        head = raw.peek(4)[:4]
    if head[:2] == b"\x1f\x8b" or path.endswith(".gz"):
        return gzip.open(raw)
    if head == b"\x28\xb5\x2f\xfd" or path.endswith((".zst", ".zstd")):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    return raw


# ---- scans by splits ---------------------------------------------------------------------------

LINES = "path string, start long, value binary"
RANGE = 32 << 20
#: How a member begins that tells its size.
MEMBER, EXTRA = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


def _split_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """Rows of LINES, a split's together and in order, to (path, start, lines)."""
    key, held = None, []
    for batch in batches:
        paths, starts, values = (c.to_pylist() for c in batch.columns)
        for path, start, value in zip(paths, starts, values, strict=True):
            if (path, start) != key:
                if key:
                    yield *key, held
                key, held = (path, start), []
            held.append(value or b"")
    if key:
        yield *key, held


def ends(lines: list[bytes]) -> list[tuple[int, int]]:
    """For each place (0: a name is next) at which a split may begin, the place at its end and the records that end in it."""
    blank = [i for i, x in enumerate(lines) if not x.strip()]
    out = []
    for place in range(4):
        at = count = done = 0
        for i in blank:
            place, done = (place + i - at) % 4, (place + i - at) // 4
            count += done
            at = i + 1
            if place:
                count, place = count + (place == 3), (place + 1) % 4
        out.append(((place + len(lines) - at) % 4, count + (place + len(lines) - at) // 4))
    return out


STATES = "path string, start long, ends array<int>, counts array<long>, head array<binary>"


def _states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, start, lines in _split_lines(batches):
        told = ends(lines)
        row = ([path], [start], [[x[0] for x in told]], [[x[1] for x in told]], [lines[:3]])
        types = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in STATES.split(", ")])


def beginnings(states: list) -> dict[tuple[str, int], tuple[int, int, int, list[bytes]]]:
    """(place, number among all, number in its file, lines that its last record lacks) of each split's first record."""
    order, out, total, before = sorted(states, key=lambda r: (r["path"], r["start"])), {}, 0, 0
    place = number = 0
    for i, r in enumerate(order):
        if not i or order[i - 1]["path"] != r["path"]:
            place = number = 0
            before = total
        end, lack = r["ends"][place], []
        if end:
            for later in order[i + 1 :]:
                if later["path"] != r["path"] or len(lack) >= 4 - end:
                    break
                lack += later["head"][: 4 - end - len(lack)]
        out[r["path"], r["start"]] = (place, before + number, number, lack)
        place, number = end, number + r["counts"][place]
        total = before + number
    return out


def _assembled(shared, phred64: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for path, start, lines in _split_lines(batches):
            place, ordinal, number, lack = shared.value[path, start]
            skip = (4 - place) % 4
            held = []

            def out(rows: list) -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True))
                return pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=names)

            first = number + (place > 0)  # what began before belongs to the split before
            for n, *record in records([*lines[skip:], *lack], phred64, first):
                held.append((ordinal - number + n, *record))
                if len(held) >= 8192:
                    yield out(held)
                    held = []
            if held:
                yield out(held)

    return run


def assembled(lines: DataFrame, phred64: bool = False) -> DataFrame:
    """Rows of LINES to records."""
    spark = lines.sparkSession
    ship(spark)
    states = lines.mapInArrow(_states, STATES).collect()
    shared = spark.sparkContext.broadcast(beginnings(states))
    return lines.mapInArrow(_assembled(shared, phred64), SCHEMA)


def _inflated(fs: pa.fs.FileSystem, path: str, at: int, end: int) -> Iterator[tuple[bool, bytes]]:
    """(inside, content) of the members from the first that begins at `at` or later; inside: it begins before end."""
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(at)
        window = f.read(1 << 17)
        skip = 0
        while at and (skip := window.find(MEMBER, skip)) >= 0 and window[skip + 12 : skip + 16] != EXTRA:
            skip += 1
        if skip < 0:
            return
        at += skip
        while at < size:
            f.seek(at)
            head = f.read(18)
            n = int.from_bytes(head[16:18], "little") + 1
            f.seek(at)
            yield at < end, zlib.decompress(f.read(n), 31)
            at += n


def _member_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uri, start, end) to the lines that begin in the range, the first after its start on, up to the first after its end."""
    for batch in batches:
        for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, path = pa.fs.FileSystem.from_uri(uri)
            rest, skip, over = b"", start > 0, False
            for inside, data in _inflated(fs, path, start, end):
                if not inside:
                    line, newline, _ = data.partition(b"\n")
                    rest, over = rest + line, bool(newline)
                    if over:
                        break
                    continue
                *lines, rest = (rest + data).split(b"\n")
                if skip and lines:
                    lines, skip = lines[1:], False
                if lines:
                    yield pa.record_batch([pa.array([uri] * len(lines)), pa.array([start] * len(lines), pa.int64()), pa.array(lines, pa.binary())], names=["path", "start", "value"])
            if not skip and (rest or over):
                yield pa.record_batch([pa.array([uri]), pa.array([start], pa.int64()), pa.array([rest], pa.binary())], names=["path", "start", "value"])


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, bytes]]:
    """(uri, size, first bytes) of the files of a path, folder or pattern."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = at.getFileSystem(conf), []
    for top in fs.globStatus(at) or ():
        for x in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if x.isFile() and not x.getPath().getName().startswith(("_", ".")):
                f = fs.open(x.getPath())
                head = bytes(b & 255 for b in (f.read() for _ in range(min(18, x.getLen()))))
                f.close()
                out.append((x.getPath().toString(), x.getLen(), head))
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def scan(spark: SparkSession, path: str, phred64: bool = False) -> DataFrame:
    """Records of a file, folder or pattern of files, numbered through; http(s) and local files whose names hide their compression are read as one stream."""
    if path.startswith(("http://", "https://")):
        return read_fastq(spark, path, phred64)
    files = _files(spark, path)
    local = all(u.startswith("file:") for u, _, _ in files)
    if local and all(h[:4] == MEMBER and h[12:16] == EXTRA for _, _, h in files):
        ranges = [(u.replace("file:/", "file:///", 1) if not u.startswith("file://") else u, a, a + RANGE) for u, n, _ in files for a in range(0, n, RANGE)]
        ship(spark)
        return assembled(spark.createDataFrame(spark.sparkContext.parallelize(ranges, len(ranges)), "uri string, start long, end long").mapInArrow(_member_lines, LINES), phred64)
    hidden = [u for u, _, h in files if (h[:2] == b"\x1f\x8b" and not u.endswith(".gz")) or h[:4] == b"\x28\xb5\x2f\xfd"]
    if hidden and local and len(files) == 1:
        return read_fastq(spark, hidden[0].replace("file:", "", 1), phred64)
    text = spark.read.option("lineSep", "\n").text([u for u, _, _ in files])
    return assembled(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")), phred64)


def sequences(path: str, fasta: bool) -> tuple[str, ...]:
    """Sequences of a small text file: one a line, or FASTA with headers, in capitals; blank lines are passed over."""
    out: list[str] = []
    with open_lines(path) as lines:
        for line in filter(None, (x.decode().strip() for x in lines)):
            if not fasta:
                out.append(line)
            elif line.startswith(">"):
                out.append("")
            elif not out:
                raise ValueError(f"{path}: a FASTA file must start with a header")
            else:
                out[-1] += line.upper()
    return tuple(out)


# ---- one stream --------------------------------------------------------------------------------


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.phred64 = options["path"], str(options.get("phred64", "false")).lower() == "true"

    def partitions(self):
        return [_File(self.path)]

    def read(self, partition):
        with open_lines(partition.value) as lines:
            yield from records(lines, self.phred64)


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path): one file; compressed text cannot be split, so repartition what follows."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_fastq(spark: SparkSession, path: str, phred64: bool = False) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("phred64", str(phred64)).load(path)


def single(reads: DataFrame) -> DataFrame:
    return reads.select("ordinal", *(F.col(c).alias(f"{c}1") for c in ("name", "seq", "plus", "qual")))


def pair_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Record k of one file with record k of the other; the job fails if one has more."""
    named = lambda df, i: df.select("ordinal", *(F.col(c).alias(f"{c}{i}") for c in ("name", "seq", "plus", "qual")))
    both = named(first, 1).join(named(second, 2), "ordinal", "full_outer")
    uneven = F.col("seq1").isNull() | F.col("seq2").isNull()
    checked = F.when(uneven, F.raise_error(F.lit("Paired input files have different read counts"))).otherwise(F.col("ordinal"))
    return both.withColumn("ordinal", checked.cast("long"))


def pair_interleaved(reads: DataFrame) -> DataFrame:
    """Records 2k and 2k + 1 as pair k; the job fails if the last one is alone."""
    cols = ("name", "seq", "plus", "qual")
    mate = lambda i: [F.max(F.when(F.col("ordinal") % 2 == i - 1, F.col(c))).alias(f"{c}{i}") for c in cols]
    both = reads.groupBy(F.floor(F.col("ordinal") / 2).alias("pair")).agg(F.count("*").alias("_n"), *mate(1), *mate(2))
    checked = F.when(F.col("_n") != 2, F.raise_error(F.lit("Interleaved input has an odd number of reads"))).otherwise(F.col("pair"))
    return both.select(checked.cast("long").alias("ordinal"), *(f"{c}{i}" for i in (1, 2) for c in cols))

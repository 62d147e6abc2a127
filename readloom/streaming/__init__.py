"""The chain over a folder that FASTQ files are laid into: stateless steps as they are, duplicates by a key store with a time limit.

Each file is a micro-batch's unit (`max_files` a trigger bounds how far it runs ahead); plain and gzip files. Records are numbered within their file.

Defined results: an empty file gives no rows; a malformed one stops the query with an error that names the record; a record that arrives again within the limit is
dropped by `distinct`, whichever file has it.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import chain as ch
from readloom.operators import dedup
from readloom.options import Options
from readloom.session import ship
from readloom.sources.fastq import records

COLS = ("name", "seq", "plus", "qual")
ARRIVED = "path string, arrived timestamp, ordinal long, " + ", ".join(f"{c}{i} string" for i in (1, 2) for c in COLS)
_TYPES = (pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), *[pa.string()] * 8)


def _parsed(interleaved: bool, phred64: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ARRIVED.split(", ")]
        for batch in batches:
            for path, when, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [r[1:] for r in records(data.splitlines(True), phred64)]
                if interleaved:
                    if len(rows) % 2:
                        raise ValueError(f"{path}: interleaved input has an odd number of reads")
                    rows = [x + y for x, y in zip(rows[::2], rows[1::2], strict=True)]
                else:
                    rows = [(*x, None, None, None, None) for x in rows]
                for low in range(0, len(rows), 8192):
                    cols = zip(*((path, when, i, *r) for i, r in enumerate(rows[low : low + 8192], low)), strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=names)

    return run


def read_stream(spark: SparkSession, folder: str, interleaved: bool = False, phred64: bool = False, max_files: int = 16) -> DataFrame:
    """Records of the files that arrive: path, arrived, ordinal (within the file), and single reads or pairs of interleaved ones as the chain takes them."""
    ship(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).load(folder)
    return files.select("path", "modificationTime", "content").mapInArrow(_parsed(interleaved, phred64), ARRIVED)


def process_stream(reads: DataFrame, o: Options) -> DataFrame:
    """The chain's rows of a stream of reads."""
    return ch.chain(reads, o)


def distinct(reads: DataFrame, limit: str = "1 hour") -> DataFrame:
    """reads without those whose bases came before, as far back as the watermark keeps their keys."""
    return reads.withColumn("key", F.sha2(dedup.key(), 256)).withWatermark("arrived", limit).dropDuplicatesWithinWatermark(["key"]).drop("key")

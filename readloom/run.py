"""Whole runs: a plan of DataFrames from options, its execution into files and reports, and calls on records in memory.

`build_plan` only declares; nothing is read beyond the bounded sample that detection asks for. What the chain made is written once into the shared
folder, and outputs and report read that.

Defined results: empty input gives empty outputs and a report of zeros; malformed input ends the run with an error that names the record; options that
do not go together are a ValueError before anything is opened.
"""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import __version__, paths
from readloom.operators import adapters, dedup, report, sinks
from readloom.operators import chain as ch
from readloom.options import Options
from readloom.session import drop_written, written
from readloom.sources import fastq

RECORD = "ordinal long, name1 string, seq1 string, plus1 string, qual1 string, name2 string, seq2 string, plus2 string, qual2 string"


def scan(spark: SparkSession, o: Options) -> DataFrame:
    """The input's records, single or paired; standard input is laid down in a local file first, so it needs a local session."""
    path = o.in1
    if path == "-":
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("standard input needs a local session: executors elsewhere do not see the driver's file")
        with tempfile.NamedTemporaryFile(prefix="readloom-stdin-", suffix=".fq", delete=False) as f:
            shutil.copyfileobj(sys.stdin.buffer, f)
        path = f.name
    read = lambda p: fastq.scan(spark, p, o.phred64)
    if o.in2:
        return fastq.pair_files(read(path), read(o.in2))
    return fastq.pair_interleaved(read(path)) if o.interleaved_in else fastq.single(read(path))


def mark(reads: DataFrame, o: Options) -> DataFrame:
    """reads with `duplicate`, if the run asks for it, by the Bloom filter of the run's accuracy."""
    if o.dont_eval_duplication and not o.dedup:
        return reads
    return dedup.mark_bloom(reads, o.dup_calc_accuracy or (3 if o.dedup else 1))


def build_plan(reads: DataFrame, o: Options) -> dict[str, DataFrame]:
    """raw records, `done` (the chain's rows, with `duplicate` if it is told) and `routes` (what each output gets), all lazy; o is taken as it is."""
    if "seq2" not in reads.columns:
        reads = reads.withColumns({c: F.lit(None).cast("string") for c in ("name2", "seq2", "plus2", "qual2")})
    raw = reads.where(F.col("ordinal") < o.reads_to_process) if o.reads_to_process else reads
    done = ch.chain(raw, replace(o, phred64=False))
    marked = mark(raw, o)
    if "duplicate" in marked.columns:
        done = done.join(marked.select("ordinal", "duplicate"), "ordinal")
    return {"raw": raw, "done": done, "routes": sinks.routes(done, o)}


@dataclass
class Result:
    """What a run gives back."""

    report: dict
    passed: int
    records: int
    files: dict[str, list[str]]


def execute(spark: SparkSession, o: Options, command: str = "") -> Result:
    """A run from files to files."""
    o = o.validate_run()
    paths.check(o)
    reads = scan(spark, o)
    o = adapters.resolve(reads, o)
    plan = build_plan(reads, o)
    done = written(plan["done"], "done")
    routed = sinks.routes(done, o)
    total = plan["raw"].count() if o.split else None
    files: dict[str, list[str]] = {}
    for route, path in paths.outputs(o).items():
        if route in ("json", "html"):
            continue
        own = routed.where(F.col("route") == route)
        if route in ("out1", "out2") and (o.split or o.split_by_lines):
            files[route] = sinks.write_split(own, o, path, total)
        elif route != "unpaired2" or path != o.unpaired1:
            shared = route == "unpaired1" and o.unpaired2 == o.unpaired1
            sinks.write_file(routed.where(F.col("route").isin("unpaired1", "unpaired2")) if shared else own, path, o.compression)
            files[route] = [path]
    if o.stdout:
        sinks.to_stdout(routed.where(F.col("route") == "merged" if o.merge else F.col("route").isin("out1", "out2")), sys.stdout)
    told = report.build(plan["raw"], done, o, o.paired, __version__)
    if o.stats_format != "off":
        files["json"] = [write_text(spark, o.json, report.as_json(told, o.stats_format))]
    if o.html:
        files["html"] = [write_text(spark, o.html, report.as_html(told, o, command))]
    drop_written(done)
    return Result(told, told["filtering_result"]["passed_filter_reads"], told["summary"]["before_filtering"]["total_reads"] // (2 if o.paired else 1), files)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path if paths.remote(path) or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def process(spark: SparkSession, in1: str, out1: str | None = None, in2: str | None = None, out2: str | None = None, **options) -> Result:
    """A run by keywords; the names are those of Options."""
    return execute(spark, Options(in1=in1, out1=out1, in2=in2, out2=out2, **options))


def process_records(spark: SparkSession, records: list[tuple], **options) -> tuple[dict[str, list[str]], dict]:
    """Records in memory, (name, seq, plus, qual) or pairs of two such tuples, through the chain: the records of each route, in order, and the report."""
    paired = bool(records) and isinstance(records[0][0], (tuple, list))
    rows = [(i, *r[0], *r[1]) if paired else (i, *r, None, None, None, None) for i, r in enumerate(records)]
    o = Options(in1="memory", interleaved_in=paired, **options).normalized().validate(paired)
    reads = spark.createDataFrame(rows, RECORD)
    o = adapters.resolve(reads, o)
    plan = build_plan(reads, o)
    out: dict[str, list[str]] = {}
    for r in plan["routes"].orderBy("ordinal", "mate").collect():
        out.setdefault(r["route"], []).append(r["record"])
    return out, report.build(plan["raw"], plan["done"], o, paired, __version__)

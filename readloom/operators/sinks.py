"""Outputs: routing of processed records, record text, interleaving, splitting, writers.

Defined results: no records, no files but an empty folder; equal ordinals keep mate 1 before mate 2; records of skipped reads go nowhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.options import Options
from readloom.session import drop_written, written

#: What a failed record's name gets, by reason; the first is for a passing mate of a failing read.
TAGS = ("paired_read_is_failing", "failed_too_many_n_bases", "failed_too_short", "failed_too_long", "failed_quality_filter", "failed_low_complexity", "failed_adapter_dimer")


def record(mate: str = "", tag: Column | None = None) -> Column:
    """The four lines of a record."""
    name = F.col(f"name{mate}")
    return F.concat_ws("\n", name if tag is None else F.concat(name, F.lit(" "), tag), f"seq{mate}", f"plus{mate}", f"qual{mate}")


def interleave(pairs: DataFrame) -> DataFrame:
    """Records of pairs, mate 1 before mate 2, with ordinals of their own."""
    each = F.array(*(F.struct((2 * F.col("ordinal") + i).alias("ordinal"), *(F.col(f"{c}{i + 1}").alias(c) for c in ("name", "seq", "plus", "qual"))) for i in (0, 1)))
    return pairs.select(F.explode(each).alias("r")).select("r.*").where("seq is not null")


def routes(done: DataFrame, o: Options) -> DataFrame:
    """(route, ordinal, mate, record) of every record that an output gets: out1, out2, merged, unpaired1, unpaired2, failed, overlapped.

    A passing mate of a failing one goes to its unpaired output if the run has one, else to the failed ones; of pairs that fail both, nothing is kept."""
    kept = done.where("not skipped")
    ok1, ok2, single = F.col("fail1") == 0, F.col("fail2") == 0, F.col("seq2").isNull()
    tag = lambda i: F.element_at(F.array(*map(F.lit, TAGS)), F.col(f"fail{i}") + 1)
    whole = lambda i: F.concat_ws("\n", F.concat(F.col(f"name{i}"), F.lit(" "), tag(i)), F.coalesce(f"whole_seq{i}", f"seq{i}"), F.col(f"plus{i}"), F.coalesce(f"whole_qual{i}", f"qual{i}"))
    to = lambda route, i, text: F.struct(F.lit(route).alias("route"), F.lit(i).alias("mate"), text.alias("record"))
    alone = {1: "unpaired1" if o.unpaired1 else None, 2: "unpaired2" if o.unpaired2 else "unpaired1" if o.unpaired1 else None}
    passing = lambda i: to(alone[i], i, record(str(i))) if alone[i] else to("failed", i, whole(i))
    pairs = F.when(single, F.when(ok1, F.array(to("out1", 1, record("1")))).otherwise(F.array(to("failed", 1, whole(1)))))
    pairs = pairs.when(ok1 & ok2, F.array(to("out1", 1, record("1")), to("out2", 2, record("2"))))
    pairs = pairs.when(ok1, F.array(passing(1), to("failed", 2, whole(2)))).when(ok2, F.array(to("failed", 1, whole(1)), passing(2)))
    if o.merge:
        text = F.concat_ws("\n", "merged_name", "merged_seq", "merged_plus", "merged_qual")
        each = F.filter(F.array(F.when(ok1, to("merged", 1, record("1"))), F.when(ok2, to("merged", 2, record("2")))), lambda x: x.isNotNull())
        pairs = F.when(F.col("merged_seq").isNotNull(), F.when(ok1, F.array(to("merged", 1, text)))).otherwise(each if o.include_unmerged else pairs)
    written_out = kept.where("not duplicate") if "duplicate" in done.columns and o.dedup else kept
    out = written_out.select("ordinal", F.explode(pairs).alias("r")).select("r.route", "ordinal", "r.mate", "r.record")
    if o.overlapped_out:  # duplicates too
        text = F.concat_ws("\n", "name1", "overlapped_seq", "plus1", "overlapped_qual")
        out = out.unionByName(kept.where("overlapped_seq is not null").select(F.lit("overlapped").alias("route"), "ordinal", F.lit(1).alias("mate"), text.alias("record")))
    return out


#: Rows that a task sorts, about, where their number is known: its memory does not grow with the table.
ROWS_OF_A_TASK = 100_000


def numbered(rows: DataFrame, total: int = 0) -> DataFrame:
    """rows, of which there are `total` if that is known, with `rank`, their place by ordinal from 0: a range-partitioned sort and sums of counts, no single task."""
    parts = max(2, rows.rdd.getNumPartitions(), -(-total // ROWS_OF_A_TASK))
    dealt = rows.repartitionByRange(parts, "ordinal").sortWithinPartitions("ordinal")
    ranked = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    runs = ranked.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(F.broadcast(runs.drop("_n")), "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def split_files(rows: DataFrame, o: Options, total: int | None = None) -> DataFrame:
    """rows with `file`, the number of the split they belong to: by lines, or into a number of files by the count of input records."""
    total = total if total is not None else rows.count()
    ranked = numbered(rows, total)
    if o.split_by_lines:
        return ranked.withColumn("file", 1 + F.floor(F.col("rank") / (o.split_by_lines // 4)))
    per = max(total // o.split, 1)
    return ranked.withColumn("file", F.least(F.lit(o.split).cast("long"), 1 + F.floor(F.col("rank") / per)))


def split_name(number: int, name: str, digits: int = 4) -> str:
    folder, slash, base = name.rpartition("/")
    return f"{folder}{slash}{str(number).zfill(digits)}.{base}"


#: Hadoop's names of the levels 1 to 9.
GZIP_LEVELS = ("BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


def write_fastq(rows: DataFrame, path: str, compression: str = "gzip", level: int = 4) -> None:
    """(ordinal, record) as text files, in ordinal order from file to file."""
    parts = max(1, rows.rdd.getNumPartitions())
    by = ["ordinal", *(["mate"] if "mate" in rows.columns else [])]
    levels = {"zlib.compress.level": GZIP_LEVELS[level - 1], "io.compression.codec.zstd.level": level}
    rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("record").write.mode("errorifexists").options(compression=compression, **levels).text(path)


def codec(path: str) -> str:
    """The codec that a file's name asks for."""
    return "gzip" if path.endswith(".gz") else "zstd" if path.endswith((".zst", ".zstd")) else "none"


def write_file(rows: DataFrame, path: str, level: int = 4) -> None:
    """(ordinal, record) as one file in ordinal order. Tasks write sorted, compressed parts into a folder beside it; gzip and zstd members and plain parts
    are a file when one follows the other, so the parts are joined as they are, by blocks."""
    spark = rows.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex[:8]}"
    write_fastq(rows, folder, codec(path), level)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, to = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    parts = sorted(x.getPath().toString() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-"))
    out = fs.create(to, True)
    try:
        for x in parts:
            source = fs.open(jvm.org.apache.hadoop.fs.Path(x))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    finally:
        out.close()
    fs.delete(at, True)


def write_split(rows: DataFrame, o: Options, path: str, total: int | None = None) -> list[str]:
    """(ordinal, record) as numbered files beside path, `0001.name` and so on; their names."""
    placed = written(split_files(rows, o, total), "split")
    names = []
    for r in sorted(placed.select("file").distinct().collect()):  # at most a name for each file to be written
        names.append(split_name(r["file"], path, o.split_prefix_digits))
        write_file(placed.where(F.col("file") == r["file"]), names[-1], o.compression)
    drop_written(placed)
    return names


def to_stdout(rows: DataFrame, stream) -> None:
    """Records in order, pairs interleaved, a partition at a time."""
    parts = max(1, rows.rdd.getNumPartitions())
    for r in rows.repartitionByRange(parts, "ordinal", "mate").sortWithinPartitions("ordinal", "mate").select("record").toLocalIterator():
        stream.write(r["record"] + "\n")

"""Command line: `python -m readloom -i in.fq -o out.fq`; long names are those of Options, with underscores or hyphens."""

from __future__ import annotations

import argparse
import shlex
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from readloom import __version__
from readloom.options import Options
from readloom.run import execute
from readloom.sources.fastq import sequences

#: Short names, and other long ones.
SHORT = {
    "in1": "i", "out1": "o", "in2": "I", "out2": "O", "length_required": "l", "disable_length_filtering": "L", "max_len1": "b", "max_len2": "B", "qualified_quality_phred": "q",
    "unqualified_percent_limit": "u", "average_qual": "e", "n_base_limit": "n", "low_complexity_filter": "y", "complexity_threshold": "Y", "json": "j", "html": "h", "compression": "z",
    "cut_mean_quality": "M", "cut_window_size": "W", "cut_front": "5", "cut_tail": "3", "cut_right": "r", "trim_front1": "f", "trim_tail1": "t", "trim_front2": "F", "trim_tail2": "T",
    "trim_poly_g": "g", "disable_trim_poly_g": "G", "trim_poly_x": "x", "disable_adapter_trimming": "A", "adapter_sequence": "a", "correction": "c", "merge": "m", "umi": "U", "dedup": "D",
    "split": "s", "split_by_lines": "S", "split_prefix_digits": "d", "phred64": "6", "verbose": "V", "disable_quality_filtering": "Q", "detect_adapter_for_pe": "2",
    "overrepresentation_analysis": "p", "overrepresentation_sampling": "P", "report_title": "R",
}
ALSO = {"in1": ["input"], "out1": ["output"], "compression": ["compression_level"], "cut_front": ["cut_by_quality5"], "cut_tail": ["cut_by_quality3"], "cut_right": ["cut_by_quality_aggressive"]}
FILES = {"adapter_fasta": True, "known_adapters": True, "filter_by_index1": False, "filter_by_index2": False}
#: Accepted for the sake of old command lines; Spark decides these.
IGNORED = {"thread": "w", "batch_bytes": None, "max_backlog": None, "max_memory": None, "parallel_compression": None}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description=__doc__, add_help=False)
    p.add_argument("--help", action="help")
    p.add_argument("-v", "--version", action="version", version=__version__)
    names = lambda n: [f"--{x}" for y in (n, *ALSO.get(n, ())) for x in dict.fromkeys((y, y.replace("_", "-")))]
    for f in fields(Options):
        flags = ([f"-{SHORT[f.name]}"] if f.name in SHORT else []) + names(f.name)
        if f.type == "bool":
            p.add_argument(*flags, dest=f.name, action="store_true")
        elif "int" in f.type:
            p.add_argument(*flags, dest=f.name, type=int, default=f.default)
        else:
            p.add_argument(*flags, dest=f.name, default=None if f.name in FILES else f.default or (None if "None" in f.type else f.default))
    p.add_argument("--discard_unmerged", action="store_true", help=argparse.SUPPRESS)
    for n, short in IGNORED.items():
        p.add_argument(*([f"-{short}"] if short else []), *names(n), dest=n, help=argparse.SUPPRESS)
    return p


def options(argv: list[str]) -> Options:
    """Options of a command line; files of sequences are read here."""
    own = vars(parser().parse_args(argv))
    for n in ("discard_unmerged", *IGNORED):
        own.pop(n)
    for n, fasta in FILES.items():
        if path := own.pop(n):
            own[n] = sequences(path, fasta)
    return Options(**own)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        o = options(argv).validate_run()
    except (ValueError, OSError) as e:
        print(f"readloom: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("readloom").getOrCreate()
    try:
        done = execute(spark, o, shlex.join(["readloom", *argv]))
    except (ValueError, OSError) as e:
        print(f"readloom: {e}", file=sys.stderr)
        return 1
    if o.verbose:
        print("\n".join(f"{route}: {', '.join(files)}" for route, files in done.files.items()), file=sys.stderr)
    print(f"{done.records} {'pairs' if o.paired else 'reads'} read, {done.passed} reads passed", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

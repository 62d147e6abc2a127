"""Column expressions over names, bases and qualities; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.options import Options


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def from_phred64(qual: Column) -> Column:
    """Qualities written from 64 on, as from 33 on."""
    return F.translate(qual, "".join(map(chr, range(64, 127))), "".join(map(chr, range(33, 96))))


def mgi_name(name: Column) -> Column:
    """A space before a mate suffix at the end of a name."""
    return F.regexp_replace(name, "(/[12])$", " $1")


def index_of(name: Column, last: bool) -> Column:
    """The sample index in a read's name: behind the last colon that has two characters or more after it, up to a plus sign; last: behind the last colon or plus."""
    scan = F.substring(name, F.lit(1), F.length(name) - 2)
    sep = "[:+]" if last else ":"
    at = F.length(F.regexp_extract(scan, f"^(.*{sep})", 1))
    rest = F.substring(name, at + 1, F.length(name))
    # a plus counts as an end only where the scan could see it
    seen = F.substring(scan, at + 1, F.length(name))
    end = F.instr(seen, "+")
    part = rest if last else F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    return F.when((F.length(name) < 5) | (at == 0) | name.isNull(), F.lit("")).otherwise(part)


def tagged(name: Column, tag: Column) -> Column:
    """tag before the first space of a name."""
    return F.concat(F.regexp_extract(name, "^([^ ]*)", 1), tag, F.regexp_extract(name, "^[^ ]*(.*)$", 1))


def with_umi(reads: DataFrame, o: Options) -> DataFrame:
    """UMI from reads or indexes into both names; a UMI in a read goes from its front, with umi_skip bases after it."""
    n, loc = F.lit(o.umi_len), o.umi_loc
    own = lambda i: F.substring(F.col(f"seq{i}"), F.lit(1), n)
    paired = F.col("seq2").isNotNull()
    value = {
        "index1": index_of(F.col("name1"), False), "index2": F.coalesce(index_of(F.col("name2"), True), F.lit("")),
        "read1": own(1), "read2": F.coalesce(own(2), F.lit("")),
        "per_read": F.when(paired, F.concat_ws("_", own(1), own(2))).otherwise(own(1)),
        "per_index": F.when(paired, F.concat_ws("_", index_of(F.col("name1"), False), index_of(F.col("name2"), True))).otherwise(index_of(F.col("name1"), False)),
    }[loc]
    tag = F.when(value == "", F.lit("")).otherwise(F.concat(F.lit(o.umi_delim + (f"{o.umi_prefix}_" if o.umi_prefix else "")), value))
    new = {f"name{i}": tagged(F.col(f"name{i}"), tag) for i in (1, 2)}
    for i in {"read1": (1,), "read2": (2,), "per_read": (1, 2)}.get(loc, ()):
        size = F.length(f"seq{i}")
        cut = F.least(F.least(n, size) + o.umi_skip, F.greatest(size - 1, F.lit(0)))
        new |= {f"{c}{i}": F.substring(F.col(f"{c}{i}"), cut + 1, size) for c in ("seq", "qual")}
    return reads.withColumns(new)


def _near(index: Column, listed: str, most: int) -> Column:
    """Whether index differs from a listed one in at most `most` places of those that both have."""
    wrong = F.zip_with(F.split(index, ""), F.array(*map(F.lit, listed)), lambda a, b: F.when((a != "") & (a != b), 1).otherwise(0))
    return F.aggregate(wrong, F.lit(0), lambda n, x: n + x) <= most


def blacklisted(o: Options) -> Column:
    out = F.lit(False)
    for name, last, listed in (("name1", False, o.filter_by_index1), ("name2", True, o.filter_by_index2)):
        for x in listed:
            out = out | F.coalesce(_near(index_of(F.col(name), last), x, o.filter_by_index_threshold), F.lit(False))
    return out


# ---- filters ----------------------------------------------------------------------------------


def count_below(qual: Column, phred: int) -> Column:
    return F.length(F.translate(qual, "".join(map(chr, range(33 + phred, 127))), "")) if phred else F.lit(0)


def count_n(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def reason(seq: Column, qual: Column, o: Options) -> Column:
    """The number of the first rule that a read breaks (0: passes), as in the kernel; mean quality and complexity, which need a look at every base, are the kernel's alone."""
    if o.average_qual > 0 or o.low_complexity_filter:
        raise ValueError("mean quality and complexity are told by the kernel: operators.chain")
    size = F.length(seq)
    out = F.when(size == 0, 2)
    if not o.disable_quality_filtering:
        out = out.when(count_below(qual, o.qualified_quality_phred) > o.unqualified_percent_limit * size / 100, 4)
        out = out.when(count_n(seq) > o.n_base_limit, 1)
    if not o.disable_length_filtering:
        out = out.when(size < o.length_required, 2)
        if o.length_limit > 0:
            out = out.when(size > o.length_limit, 3)
    return out.otherwise(0)

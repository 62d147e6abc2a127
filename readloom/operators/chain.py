"""The preprocessing chain: name rewriting in expressions, then one fused Arrow kernel for everything that scans bases.

The order of steps is part of the result: index blacklist, name repair, UMI, trims and cuts, poly-G, overlap, insert size, correction,
adapters, dimers, overlapped region, poly-X, maximal length, filters, merge. The kernel keeps nothing between batches, so any partitioning
gives the same rows; counters are columns, and totals are ordinary sums.

Defined results: a null sequence or quality is empty; an empty read is too short; a pair without mate 2 is a single read; repeated ordinals are records of
their own; no rows give no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import exprs, mates
from readloom.functions.mates import Mates
from readloom.options import Options
from readloom.session import ship

#: Reasons in order of severity; a pair's reason is the larger of its mates'.
REASONS = ("passed_filter", "too_many_N", "too_short", "too_long", "low_quality", "low_complexity", "adapter_dimer")
PASS, MANY_N, SHORT, LONG, QUALITY, COMPLEXITY, DIMER = range(7)

OUT = (
    ("ordinal", "long", pa.int64()), ("name1", "string", pa.string()), ("seq1", "string", pa.string()), ("plus1", "string", pa.string()), ("qual1", "string", pa.string()),
    ("name2", "string", pa.string()), ("seq2", "string", pa.string()), ("plus2", "string", pa.string()), ("qual2", "string", pa.string()),
    ("skipped", "boolean", pa.bool_()), ("fail1", "int", pa.int32()), ("fail2", "int", pa.int32()),
    ("ov_found", "boolean", pa.bool_()), ("ov_offset", "int", pa.int32()), ("ov_len", "int", pa.int32()), ("ov_diff", "int", pa.int32()),
    ("insert_size", "int", pa.int32()), ("corrected_bases", "int", pa.int32()), ("corrected_reads", "int", pa.int32()),
    ("adapter_bases", "int", pa.int32()), ("adapter_reads", "int", pa.int32()), ("polyx_base1", "int", pa.int32()), ("polyx_n1", "int", pa.int32()), ("polyx_base2", "int", pa.int32()), ("polyx_n2", "int", pa.int32()),
    ("merged_name", "string", pa.string()), ("merged_seq", "string", pa.string()), ("merged_plus", "string", pa.string()), ("merged_qual", "string", pa.string()),
    ("overlapped_seq", "string", pa.string()), ("overlapped_qual", "string", pa.string()),
    ("whole_seq1", "string", pa.string()), ("whole_qual1", "string", pa.string()), ("whole_seq2", "string", pa.string()), ("whole_qual2", "string", pa.string()),
)
SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in OUT)
IN = ("ordinal", "name1", "seq1", "plus1", "qual1", "name2", "seq2", "plus2", "qual2", "skipped")


def quality_sum(m: Mates) -> np.ndarray:
    return np.where(m.inside, m.qual, 0).sum(axis=1, dtype=np.int64) - 33 * m.size


def count_below(m: Mates, phred: int) -> np.ndarray:
    """Bases of a quality below this one; none where it is 0."""
    return (m.inside & (m.qual < phred + 33)).sum(axis=1) if phred else np.zeros(len(m.size), np.int64)


def count_n(m: Mates) -> np.ndarray:
    return (((m.seq | 32) == ord("n")) & m.inside).sum(axis=1)


def filter_reason(m: Mates, o: Options) -> np.ndarray:
    """The first rule that each read breaks."""
    size, inside = m.size, m.inside
    out = np.zeros(len(size), np.int32)
    if o.low_complexity_filter:
        steps = ((m.seq[:, 1:] != m.seq[:, :-1]) & inside[:, 1:]).sum(axis=1)
        low = (size <= 1) | (steps / np.maximum(size - 1, 1) < o.complexity_threshold / 100)
        out[low] = COMPLEXITY
    if not o.disable_length_filtering:
        if o.length_limit > 0:
            out[size > o.length_limit] = LONG
        out[size < o.length_required] = SHORT
    if not o.disable_quality_filtering:
        out[count_n(m) > o.n_base_limit] = MANY_N
        if o.average_qual > 0:
            out[quality_sum(m) // np.maximum(size, 1) < o.average_qual] = QUALITY
        out[count_below(m, o.qualified_quality_phred) > o.unqualified_percent_limit * size / 100] = QUALITY
    out[size == 0] = SHORT
    return out


def where(rows: np.ndarray, values: pa.Array) -> pa.Array:
    """values in the given rows, else null."""
    return pc.if_else(pa.array(rows), values, pa.scalar(None, values.type))


def process(batch: pa.RecordBatch, o: Options) -> pa.RecordBatch:
    """A batch of IN columns to a batch of OUT columns."""
    col = {c: batch.column(i) for i, c in enumerate(IN)}
    paired = col["seq2"].null_count < len(col["seq2"])
    n = batch.num_rows
    m1 = Mates.of(col["seq1"], col["qual1"])
    both = [m1] + ([Mates.of(col["seq2"], col["qual2"])] if paired else [])
    m2 = both[-1]
    zero = np.zeros(n, np.int64)
    out: dict = {"adapter_bases": zero.copy(), "insert_size": None}
    whole = [m.view() for m in both]
    cuts = {k: o.cut(k) for k in ("front", "right") if getattr(o, f"cut_{k}")}
    if o.cut_tail and not o.cut_right and not o.disable_trim_tail:
        cuts["tail"] = o.cut("tail")
    front1, tail1 = max(o.trim_front1, o.trim_front), max(o.trim_tail1, o.trim_tail)
    fronts = [zero, zero]
    for i, m in enumerate(both):
        f, t = (front1, tail1) if i == 0 else (front1 if o.trim_front2 is None else o.trim_front2, tail1 if o.trim_tail2 is None else o.trim_tail2)
        if f or t or cuts:
            fronts[i] = mates.quality_cut(m, f, t, cuts)
        if o.trim_poly_g and not o.disable_trim_poly_g:
            mates.poly_g(m, o.poly_g_min_len)
    found, offset, length, diff = np.zeros(n, bool), zero, zero, zero
    use, use_offset, use_len = found, zero, zero
    limits = (o.overlap_len_require, o.overlap_diff_limit, o.overlap_diff_percent_limit)
    if paired and (o.corrects or o.overlapped_out or not o.disable_adapter_trimming):
        found, offset, length, diff = mates.overlap(m1, m2, *limits)
        use, use_offset, use_len = found, offset, length
        if o.allow_gap_overlap_trimming and not o.disable_adapter_trimming:
            g, go, gl = mates.gap_overlap(m1, m2, ~found, *limits)
            use, use_offset, use_len = found | g, np.where(g, go, offset), np.where(g, gl, length)
    searched = [m.size.copy() for m in both]
    if paired:
        size = np.where(offset > 0, m1.size + m2.size - length, length) + fronts[0] + fronts[1]
        out["insert_size"] = pa.array(size, pa.int32(), mask=~found)
    out["corrected_bases"], out["corrected_reads"] = mates.correct(m1, m2, found & (diff > 0), offset, length) if paired and o.corrects else (zero, zero)
    trimmed = np.zeros((len(both), n), bool)
    if not o.disable_adapter_trimming:
        by_overlap = use & (use_offset < 0) & paired
        if by_overlap.any():
            for i, m in enumerate(both):
                keep = np.minimum(m.size, use_len + fronts[1 - i])
                out["adapter_bases"] += np.where(by_overlap, m.size - keep, 0)
                m.resize(keep, by_overlap)
                trimmed[i] |= by_overlap
        least = 6 if len(o.adapter_fasta) > 256 else 5 if len(o.adapter_fasta) > 16 else 4
        second = o.adapter_sequence_r2 or (None if o.detect_adapter_for_pe else o.adapter_sequence)
        for i, m in enumerate(both):
            own = (o.adapter_sequence, second)[i]
            for adapter, k, free in [(own, 4, ~by_overlap)] * bool(own) + [(x, least, np.ones(n, bool)) for x in o.adapter_fasta]:
                hit, place, gone = mates.find_adapter(m, adapter.encode(), k)
                hit &= free
                out["adapter_bases"] += np.where(hit, gone, 0)
                m.resize(place, hit)
                trimmed[i] |= hit
    out["adapter_reads"] = trimmed.sum(axis=0)
    dimer = trimmed.any(axis=0) & np.all([m.size <= o.dimer_max_len for m in both], axis=0)
    if o.overlapped_out and paired:
        f, off, ln, d = mates.overlap(m1, m2, o.overlap_len_require, o.overlap_diff_limit, 0)
        f &= d == 0
        rest = m1.view()
        rest.drop_front(np.where(f, np.maximum(off, 0) + ln, 0))
        for c, x in (("seq", rest.seq), ("qual", rest.qual)):
            out[f"overlapped_{c}"] = where(f, mates.strings(x, rest.size))
    reasons = []
    for i, m in enumerate(both):
        base, k = mates.poly_x(m, o.poly_x_min_len) if o.trim_poly_x else (np.full(n, -1), zero)
        out[f"polyx_base{i + 1}"], out[f"polyx_n{i + 1}"] = base, k
        top = o.max_len1 if i == 0 or o.max_len2 is None else o.max_len2
        if top > 0:
            m.resize(np.full(n, top))
        reasons.append(np.where(dimer, DIMER, filter_reason(m, o)))
    if o.merge and paired:
        again = np.flatnonzero((out["corrected_bases"] > 0) | (m1.size != searched[0]) | (m2.size != searched[1]))
        f, off, ln = found.copy(), offset.copy(), length.copy()
        if len(again):
            f[again], off[again], ln[again], _ = mates.overlap(m1.take(again), m2.take(again), *limits)
        one = mates.merged(m1, m2, f, off, ln)
        why = filter_reason(one, o)
        reasons = [np.where(f, why, r) for r in reasons]
        len1, len2 = ln + np.maximum(off, 0), np.where(off > 0, m2.size - ln, 0)
        suffix = pc.binary_join_element_wise(" merged", *(pa.array(x).cast(pa.string()) for x in (len1, len2)), "_")
        f = f.astype(bool)
        out["merged_name"] = where(f, pc.binary_join_element_wise(col["name1"], suffix, ""))
        out["merged_plus"] = where(f, pc.if_else(pc.equal(col["plus1"], "+"), col["plus1"], pc.binary_join_element_wise(col["plus1"], suffix, "")))
        for c, x in (("seq", one.seq), ("qual", one.qual)):
            out[f"merged_{c}"] = where(f, mates.strings(x, one.size))
    out |= {"ov_found": found, "ov_offset": pa.array(offset, pa.int32(), mask=~found), "ov_len": pa.array(length, pa.int32(), mask=~found), "ov_diff": pa.array(diff, pa.int32(), mask=~found)}
    for i, m in enumerate(both, 1):
        out[f"seq{i}"], out[f"qual{i}"], out[f"fail{i}"] = mates.strings(m.seq, m.size), mates.strings(m.qual, m.size), reasons[i - 1]
        gone = (m.size == 0) & (whole[i - 1].size > 0)
        for c, x in (("seq", whole[i - 1].seq), ("qual", whole[i - 1].qual)):
            if gone.any():
                out[f"whole_{c}{i}"] = where(gone, mates.strings(x, whole[i - 1].size))
    for c in ("ordinal", "name1", "plus1", "name2", "plus2", "skipped"):
        out[c] = col[c]
    arrays = []
    for name, _, kind in OUT:
        x = out.get(name)
        arrays.append(pa.nulls(n, kind) if x is None else x.cast(kind) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x).cast(kind))
    return pa.record_batch(arrays, names=[x[0] for x in OUT])


def _kernel(o: Options):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):  # small matrices stay in the cache
                yield process(batch.slice(low, 2048), o)

    return run


def _figures(rules: tuple[Options, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ordinal", "unqualified", "quality_sum", "n_bases", *(f"reason{i}" for i in range(len(rules)))]
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                m = Mates.of(part.column(1), part.column(2))
                sums = pa.array(count_below(m, rules[0].qualified_quality_phred), pa.int32()), pa.array(quality_sum(m), pa.int64()), pa.array(count_n(m), pa.int32())
                yield pa.record_batch([part.column(0), *sums, *(pa.array(filter_reason(m, o), pa.int32()) for o in rules)], names=names)

    return run


def filter_figures(reads: DataFrame, *rules: Options) -> DataFrame:
    """Of each mate 1: bases below the first rules' quality, sum of qualities, undetermined bases, and `reason0`, `reason1`, ... by each of the given rules."""
    ship(reads.sparkSession)
    schema = "ordinal long, unqualified int, quality_sum long, n_bases int" + "".join(f", reason{i} int" for i in range(len(rules)))
    return reads.select("ordinal", "seq1", "qual1").mapInArrow(_figures(rules), schema)


def prepare(reads: DataFrame, o: Options) -> DataFrame:
    """Everything before the kernel, in expressions: read limit, quality offset, blacklist, names, UMI."""
    if "seq2" not in reads.columns:
        reads = reads.withColumns({c: F.lit(None).cast("string") for c in ("name2", "seq2", "plus2", "qual2")})
    if o.reads_to_process:
        reads = reads.where(F.col("ordinal") < o.reads_to_process)
    if o.phred64:
        reads = reads.withColumns({c: exprs.from_phred64(F.col(c)) for c in ("qual1", "qual2")})
    reads = reads.withColumn("skipped", exprs.blacklisted(o))
    if o.fix_mgi_id:
        reads = reads.withColumns({c: exprs.mgi_name(F.col(c)) for c in ("name1", "name2")})
    return exprs.with_umi(reads, o) if o.umi else reads


def chain(reads: DataFrame, o: Options) -> DataFrame:
    """Pairs (or single reads, mate 2 null) through the whole chain: one row each, OUT columns."""
    ship(reads.sparkSession)
    return prepare(reads, o).select(*IN).mapInArrow(_kernel(o), SCHEMA)

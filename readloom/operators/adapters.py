"""Adapter detection on a bounded prefix of the reads: known sequences first, then discovery from frequent 10-mers.

The sample is a fixed bound (SAMPLE_READS reads or SAMPLE_BASES bases of mate 1, whichever comes first), so its sequences go to the driver; what comes of it
are options. Everything is vectorised over the sample.

Defined results: fewer than LEAST_READS reads detect nothing; null sequences are empty; of equally good known adapters the first in the list wins.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import mates
from readloom.options import Options

#: The sample, and the least number of reads that detection works on.
SAMPLE_READS, SAMPLE_BASES, LEAST_READS = 256 * 1024, 151 * 256 * 1024, 10_000
#: Most reads and bases that known adapters are looked for in, and the count that ends it.
KNOWN_READS, KNOWN_BASES, KNOWN_ENOUGH = 100_000, 100_000_000, 1000
#: Fixed values of discovery: seed length, first place, most places, least count, share of all in 2^20, least branch, share of a branch, longest adapter.
SEED, FIRST, LAST, LEAST, SHARE, BRANCH, MAJORITY, LONGEST = 10, 20, 500, 10, 20, 50, 0.95, 60
BASES = b"ATCG"
#: Beginnings of names of instruments that write G where they see nothing.
POLY_G_NAMES = ("@FS", "@MN", "@SH", "@NS", "@NB", "@NDX", "@VL", "@VH", "@A", "@NA", "@LH")


def sample(reads: DataFrame) -> pa.Table:
    """(ordinal, name1, seq1, seq2) of the first reads, in order; the name of the first alone."""
    cols = ["ordinal", F.when(F.col("ordinal") == 0, F.col("name1")).alias("name1"), *(c for c in ("seq1", "seq2") if c in reads.columns)]
    table = reads.where(F.col("ordinal") < SAMPLE_READS).select(*cols).orderBy("ordinal").toArrow()
    sizes = np.cumsum([len(s or "") for s in table["seq1"].to_pylist()])
    return table.slice(0, int(np.searchsorted(sizes, SAMPLE_BASES)) + 1)


def matches(seqs: list[str], adapter: str) -> np.ndarray:
    """Of each read the differences at the first place where the adapter, or its beginning, fits; -1 where it does not."""
    seq, size = mates.matrix(pa.array(seqs, pa.string()))
    a, out = np.frombuffer(adapter.encode(), np.uint8), np.full(len(seqs), -1, np.int64)
    rows = np.flatnonzero(size > len(a))
    for pos in range(max(0, seq.shape[1] - 8)):
        own = rows[pos < size[rows] - 8]
        if not len(own):
            break
        span = np.minimum(size[own] - pos, len(a))
        w = int(span.max())
        part = seq[own, pos : pos + w]
        wrong = ((part != a[None, : part.shape[1]]) & (np.arange(part.shape[1])[None, :] < span[:, None])).sum(axis=1)
        fits = wrong <= span // 16
        out[own[fits]] = wrong[fits]
        rows = rows[out[rows] < 0]
    return out


def known_adapter(seqs: list[str], adapters: tuple[str, ...]) -> str | None:
    """The known adapter that fits most reads, read in order, if they are enough of them; one that falls far behind is no longer counted."""
    found = [[] for _ in seqs[:KNOWN_READS]]
    for i, a in enumerate(adapters):
        own = matches(seqs[:KNOWN_READS], a)
        for r in np.flatnonzero(own >= 0).tolist():
            found[r].append((i, int(own[r])))
    counts, wrong, checked, bases, most = [0] * len(adapters), [0] * len(adapters), 0, 0, 0
    for r, seq in enumerate(seqs):
        checked, bases = checked + 1, bases + len(seq)
        if checked > KNOWN_READS or bases > KNOWN_BASES or most > KNOWN_ENOUGH:
            break
        for i, diff in found[r]:
            if most <= 20 or counts[i] >= most // 10:
                counts[i] += 1
                wrong[i] += diff
                most = max(most, counts[i])
    if not counts:
        return None
    best = counts.index(max(counts))
    return adapters[best] if counts[best] > checked // 50 or (counts[best] > checked // 200 and wrong[best] < checked) else None


def seed_counts(seqs: list[str], shift: int) -> np.ndarray:
    """How often each 10-mer stands behind the first bases; its number has two bits a base, in the order ATCG."""
    code = np.full(256, 4, np.int64)
    code[list(BASES)] = range(4)
    out = np.zeros(1 << (2 * SEED), np.int64)
    for low in range(0, len(seqs), 4096):
        seq, size = mates.matrix(pa.array(seqs[low : low + 4096], pa.string()))
        c, width = code[seq], seq.shape[1] - SEED + 1
        if width <= FIRST:
            continue
        number, good = np.zeros((len(c), width - FIRST), np.int64), np.ones((len(c), width - FIRST), bool)
        for i in range(SEED):
            part = c[:, FIRST + i : width + i]
            number = number * 4 + part
            good &= part < 4
        good &= np.arange(FIRST, width)[None, :] <= (size - SEED - shift)[:, None]
        out += np.bincount(number[good], minlength=len(out))
    return out


def best_seeds(counts: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """The ten most frequent seeds (number, count) that are not of low complexity, and the sum of all such counts."""
    at = np.flatnonzero(counts)
    at = at[at > 0]
    bases = (at[:, None] >> (2 * np.arange(SEED))[None, :]) & 3
    each = np.stack([(bases == b).sum(axis=1) for b in range(4)])
    at = at[~((each >= 6).any(axis=0) | (each[2] + each[3] >= 8) | (at >> 12 == 255))]
    order = np.lexsort((-at, -counts[at]))[:10]
    return [(int(x), int(counts[x])) for x in at[order]], int(counts[at].sum())


def majority_path(sides: Counter) -> tuple[str, bool]:
    """From the root the bases that MAJORITY of what goes on agrees on; and whether it ended for want of support, not of agreement."""
    path, live = "", sides
    while True:
        after = Counter()
        for s, n in live.items():
            if len(s) > len(path):
                after[s[len(path)]] += n
        total = sum(after.values())
        if total < BRANCH:
            return path, True
        base, n = max(after.items(), key=lambda x: x[1])
        if n / total < MAJORITY:
            return path, False
        path += base
        live = Counter({s: n for s, n in live.items() if s.startswith(path)})


def discover(seqs: list[str], adapters: tuple[str, ...], shift: int) -> str | None:
    """An adapter that is in no list: a frequent seed, extended to both sides as far as the reads agree."""
    seeds, total = best_seeds(seed_counts(seqs, shift))
    for number, n in seeds:
        if n < LEAST or n * (1 << 20) < total * SHARE:
            return None
        seed = "".join(chr(BASES[number >> (2 * i) & 3]) for i in range(SEED - 1, -1, -1))
        if sum(a != b for a, b in zip(seed, seed[1:], strict=False)) < 3:
            continue
        right, left = Counter(), Counter()
        for s in seqs:
            end, at = min(LAST, len(s) - SEED - shift + 1), s.find(seed, FIRST)
            while 0 <= at < end:
                right[s[at + SEED : len(s) - shift].split("N")[0]] += 1
                left[s[:at][::-1].split("N")[0]] += 1
                at = s.find(seed, at + 1)
        (after, whole1), (before, whole2) = majority_path(right), majority_path(left)
        adapter = (before[::-1] + seed + after)[:LONGEST]
        for known in adapters:
            if adapter.startswith(known):
                return known
        if whole1 and whole2:
            return adapter
    return None


def detect(seqs: list[str], adapters: tuple[str, ...], trim_tail: int = 0) -> str | None:
    if len(seqs) < LEAST_READS:
        return None
    return known_adapter(seqs, adapters) or discover(seqs, adapters, max(trim_tail, 1))


def resolve(reads: DataFrame, o: Options) -> Options:
    """Options with the adapters and the poly-G trimming that the first reads ask for. Given adapters stay; `auto` is none given."""
    given = [None if a is None or a == "auto" else a.upper() for a in (o.adapter_sequence, o.adapter_sequence_r2)]
    paired, searched = o.paired, not o.disable_adapter_trimming and not o.disable_adapter_detection
    wanted = searched and o.in1 != "-" and (o.detect_adapter_for_pe if paired else True) and not all(given[: 1 + paired])
    first = sample(reads) if wanted else reads.where(F.col("ordinal") == 0).limit(1).toArrow() if o.in1 != "-" else None
    if wanted and first.num_rows >= LEAST_READS:
        for i in (0, 1) if paired else (0,):
            given[i] = given[i] or detect([s or "" for s in first[f"seq{i + 1}"].to_pylist()], o.known_adapters, o.trim_tail1)
    if paired and given[1] is None and not o.detect_adapter_for_pe:
        given[1] = given[0]
    name = first["name1"][0].as_py() if first is not None and first.num_rows else ""
    poly_g = not o.disable_trim_poly_g and (o.trim_poly_g or (name or "").startswith(POLY_G_NAMES))
    return replace(o, adapter_sequence=given[0], adapter_sequence_r2=given[1], trim_poly_g=poly_g)

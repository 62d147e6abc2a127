"""Read operators: every query against its SQL, kernels against plain loops, sources and routes on literals."""

import gzip
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import mates
from readloom.functions.mates import Mates
from readloom.operators import chain as ch
from readloom.operators import dedup, overrep, profile, sinks
from readloom.options import KNOWN_ADAPTERS, Options
from readloom.plans.queries import ORACLE_SQL, QUERIES
from readloom.sources import fastq
from readloom.sources.recipe import reads

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(None if v is None else round(float(v), 5) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{SF}/orders.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert list(map(repr, rows(got))) == list(map(repr, rows(want)))


def batch(seqs, quals=None):
    return Mates.of(pa.array(seqs), pa.array(quals or ["I" * len(s) for s in seqs]))


def texts(m):
    return mates.strings(m.seq, m.size).to_pylist()


def random_reads(n, seed, bases="ACGT", low=0, high=60):
    r = random.Random(seed)
    return ["".join(r.choice(bases) for _ in range(r.randint(low, high))) for _ in range(n)]


def plain_poly_g(s, least):
    wrong, first, compared = 0, max(len(s) - 1, 0), 0
    for i, b in enumerate(reversed(s)):
        if b != "G":
            wrong += 1
        else:
            first = len(s) - 1 - i
        if wrong > 5 or (wrong > (i + 1) // 8 and i + 1 >= least):
            break
        compared += 1
    return s[:first] if compared >= least else s


def test_poly_g_equals_a_plain_loop():
    seqs = [x + "".join(random.Random(i).choice("GGGGGGGA") for _ in range(i % 30)) for i, x in enumerate(random_reads(600, 1))] + ["", "G", "G" * 30]
    m = batch(seqs)
    mates.poly_g(m, 10)
    assert texts(m) == [plain_poly_g(s, 10) for s in seqs]


def plain_overlap(a, b, least=30, most=5, percent=20):
    rc = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
    if not a or not b:
        return None
    for o in [*range(max(len(a) - least, 0)), *(-k for k in range(max(len(b) - least, 0)))]:
        x, y = a[max(o, 0) :], rc[max(-o, 0) :]
        n = min(len(x), len(y))
        limit = min(most, n * percent // 100)
        if sum(p != q for p, q in zip(x[: min(50, n)], y, strict=False)) <= limit:
            return o, n, sum(p != q for p, q in zip(x[:n], y[:n], strict=True))
    return None


def test_overlap_equals_a_plain_loop():
    r, a, b = random.Random(3), [], []
    for _ in range(400):
        ins = "".join(r.choice("ACGT") for _ in range(r.randint(5, 120)))
        rc = ins[::-1].translate(str.maketrans("ACGT", "TGCA"))
        x, y = (list((s + "".join(r.choice("ACGT") for _ in range(90)))[: r.randint(0, 90)]) for s in (ins, rc))
        for s in (x, y):
            for _ in range(r.randint(0, 4)):
                if s:
                    s[r.randrange(len(s))] = r.choice("ACGTN")
        a.append("".join(x))
        b.append("".join(y))
    found, offset, length, diff = mates.overlap(batch(a), batch(b), 30, 5, 20)
    got = [(int(o), int(n), int(d)) if f else None for f, o, n, d in zip(found, offset, length, diff, strict=True)]
    assert got == [plain_overlap(x, y) for x, y in zip(a, b, strict=True)]
    assert any(got) and not all(got)


def plain_adapter(s, a, least):
    """Position and bases gone, by the three stages."""
    if len(a) < least or len(s) <= least:
        return None
    for pos in range(-4 if len(a) >= 16 else -3 if len(a) >= 12 else -2 if len(a) >= 8 else 0, len(s) - least):
        n = min(len(s) - pos, len(a))
        skip = max(-pos, 0)
        if sum(s[pos + k] != a[k] for k in range(skip, n)) <= n // 8:
            return max(pos, 0), len(a) + pos if pos < 0 else len(s) - pos

    def gap(ins, normal, n, limit):
        if len(ins) <= n or len(normal) < n:
            return False
        tail = ins[n] != normal[n - 1]
        if (ins[0] != normal[0]) + tail > limit:
            return False
        for i in range(1, n):
            left = sum(ins[j] != normal[j] for j in range(i))
            if left + tail > limit:
                return False
            if left + sum(ins[j + 1] != normal[j] for j in range(i, n)) <= limit:
                return True
        return False

    for insertion in (True, False):
        for pos in range(max(len(s) - least - insertion, 0)):
            n = min(len(s) - pos - 1, len(a)) if insertion else min(len(s) - pos, len(a) - 1)
            if n >= 8 and (gap(s, a, n, n // 8 - 1) if insertion else gap(a, s, n, n // 8 - 1)):
                return pos, len(s) - pos
    return None


@pytest.mark.parametrize("adapter", ["AGATCGGAAGAGCACACGTC", "ACGTACGTAC", "TTAGG"])
def test_adapter_equals_a_plain_loop(adapter):
    r, seqs = random.Random(5), ["", "A", adapter, adapter[3:] + "ACGTTTGACCA"]
    for _ in range(300):
        a = list(adapter)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(a))
            r.choice((lambda a=a, k=k: a.insert(k, "T"), lambda a=a, k=k: a.pop(k), lambda a=a, k=k: a.__setitem__(k, "C")))() if len(a) > 2 else None
        seqs.append("".join(r.choice("ACGT") for _ in range(r.choice((0, 0, 5, 30)))) + "".join(a)[: r.randint(1, 25)] + "ACCA" * r.randint(0, 2))
    found, where, gone = mates.find_adapter(batch(seqs), adapter.encode(), 4)
    got = [(int(p), int(g)) if f else None for f, p, g in zip(found, where, gone, strict=True)]
    assert got == [plain_adapter(s, adapter, 4) for s in seqs]


def pair(spark, seq1, qual1, seq2, qual2, name="@r 1:N:0:ACGT+TTTT"):
    return spark.createDataFrame([(0, name, seq1, "+", qual1, name.replace(" 1", " 2"), seq2, "+", qual2)], "ordinal long, name1 string, seq1 string, plus1 string, qual1 string, name2 string, seq2 string, plus2 string, qual2 string")


def test_correction_takes_the_good_base(spark):
    s = "ACGTTGCAAC" * 7
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    wrong = rc[:20] + ("A" if rc[20] != "A" else "C") + rc[21:]
    r = ch.chain(pair(spark, s, "I" * 70, wrong, "I" * 20 + "!" + "I" * 49), Options(correction=True)).first()
    assert (r["seq2"], r["qual2"], r["corrected_bases"], r["corrected_reads"]) == (rc, "I" * 70, 1, 1)


def test_empty_and_short_reads(spark):
    r = ch.chain(pair(spark, "", "", "ACGT", "IIII"), Options(merge=True, cut_front=True, cut_tail=True, trim_poly_g=True, trim_poly_x=True)).first()
    assert (r["fail1"], r["fail2"], r["merged_seq"], r["whole_seq2"]) == (ch.SHORT, ch.SHORT, None, "ACGT")
    none = pair(spark, "A", "I", "A", "I").limit(0)
    assert ch.chain(none, Options()).count() == 0 and dedup.mark_exact(none).count() == 0 and profile.kmers(profile.long_form(none)).count() == 0


def test_any_partitioning_gives_the_same(spark):
    o = Options(correction=True, merge=True, cut_tail=True, trim_poly_x=True)
    want = sorted(map(repr, ch.chain(reads(spark, SF), o).collect()))
    assert sorted(map(repr, ch.chain(reads(spark, SF).repartition(7), o).collect())) == want


def test_bloom_levels_agree_on_small_data(spark):
    some = reads(spark, SF).where("ordinal < 400")
    want = sorted(dedup.mark_exact(some).where("duplicate").select("ordinal").collect())
    assert sorted(dedup.mark_bloom(some, 3).where("duplicate").select("ordinal").collect()) == want and want


def test_a_task_makes_a_bounded_number_of_reads(spark, monkeypatch):
    monkeypatch.setattr("readloom.sources.recipe.READS_OF_A_TASK", 100)
    sizes = reads(spark, SF).select("ordinal").rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(sizes) == 1500 and max(sizes) <= 120


@pytest.mark.parametrize("o", [Options(split_by_lines=1000), Options(split=7)])
def test_splits_are_numbered_by_tasks_of_bounded_size(spark, monkeypatch, o):
    monkeypatch.setattr(sinks, "ROWS_OF_A_TASK", 100)
    kept, own = [], sinks.written
    monkeypatch.setattr(sinks, "written", lambda *x: kept.append(own(*x)) or kept[-1])
    placed = sinks.split_files(reads(spark, SF).coalesce(1), o).select("ordinal", "rank", "file", "seq2").toPandas().sort_values("ordinal")
    assert list(placed["rank"]) == list(range(1500)) and placed["seq2"].notna().all()
    assert max(r["count"] for r in kept[0].groupBy(F.input_file_name()).count().collect()) <= 300
    assert list(placed["file"]) == [1 + i // 250 if o.split_by_lines else min(7, 1 + i // (1500 // 7)) for i in range(1500)]


@pytest.mark.parametrize(("least", "most", "percent"), [(1, 5, 20), (3, 0, 0), (4, 40, 60), (30, 5, 20)])
def test_overlaps_of_repeats_and_short_reads_equal_a_plain_loop(least, most, percent):
    r = random.Random(least)
    a = [*random_reads(150, 1, "ACGTNn", 0, 12), *random_reads(100, 2, "AC", 20, 90), *["A" * 70, "AC" * 40, "ACG" * 30, "", "A"]]
    b = [x.translate(str.maketrans("ACGT", "TGCA"))[::-1][r.randint(0, 8) :] for x in a[:-3]] + random_reads(3, 3, "ACGT", 0, 50)
    found, offset, length, diff = mates.overlap(batch(a), batch(b), least, most, percent)
    got = [(int(o), int(n), int(d)) if f else None for f, o, n, d in zip(found, offset, length, diff, strict=True)]
    want = [plain_overlap(x, y, least, most, percent) for x, y in zip(a, b, strict=True)]
    assert got == want and any(want)


def test_filter_figures_equal_plain_counts_without_expressions_over_bases(spark):
    r = random.Random(5)
    seqs = [*random_reads(300, 5, "ACGTNn"), "", "A", "AA", "ACGT" * 40, None]
    quals = [s and "".join(chr(33 + r.randint(0, 41)) for _ in s) for s in seqs]
    table = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(zip(seqs, quals, strict=True))], "ordinal long, seq1 string, qual1 string")
    o = Options(average_qual=19, low_complexity_filter=True, complexity_threshold=70, length_required=5, length_limit=40)

    def plain(s, q, o):
        q = [ord(c) - 33 for c in q]
        if not s or sum(x < 15 for x in q) > 40 * len(s) / 100 or sum(q) // len(s) < 19:
            return 4 if s else 2
        if s.lower().count("n") > 5:
            return 1
        if len(s) < 5 or len(s) > o.length_limit:
            return 2 if len(s) < 5 else 3
        return 5 if sum(a != b for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1) < 0.7 else 0

    other = Options(average_qual=19, low_complexity_filter=True, complexity_threshold=70, length_required=5, length_limit=50)
    got = {x[0]: tuple(x[1:]) for x in ch.filter_figures(table, o, other).collect()}
    for i, (s, q) in enumerate(zip(seqs, quals, strict=True)):
        s, q = s or "", q or ""
        assert got[i] == (sum(ord(c) < 48 for c in q), sum(ord(c) - 33 for c in q), s.lower().count("n"), plain(s, q, o), plain(s, q, other)), (s, q)
    plan = QUERIES["filter_each_rule"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan and "lambdafunction(" not in plan


def test_bloom_query_is_exact_where_bits_meet(spark, monkeypatch):
    monkeypatch.setitem(dedup.LEVELS, 1, (10, 2))  # 1,500 records fill 1,024 bits
    want = sorted(map(tuple, dedup.mark_exact(reads(spark, SF)).select("ordinal", "duplicate").collect()))
    assert sorted(map(tuple, dedup.mark_bloom(reads(spark, SF)).select("ordinal", "duplicate").collect())) != want
    assert sorted(map(tuple, QUERIES["bloom_dup"](spark, SF).collect())) == want


@pytest.mark.parametrize("name", ["dedup_exact", "duplication_rate"])
def test_exact_duplicates_are_told_of_reads_made_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "qual1" not in plan  # the recipe's bases are not computed for either side of the join


def test_duplicates_of_null_sequences(spark):
    some = spark.createDataFrame([(0, None, None), (1, "", None), (2, "AC", None), (3, None, "AC"), (4, "GG", None)], "ordinal long, seq1 string, seq2 string")
    for marked in (dedup.mark_exact(some), dedup.mark_bloom(some), dedup.mark_bloom(some, exact=True)):
        assert [r["duplicate"] for r in marked.orderBy("ordinal").collect()] == [False, True, False, True, False]


def test_fastq_source(spark, tmp_path):
    text = b"\n@a 1\nACGT\n+\nIIII\n  \n@b\r\nAC\r\n+b\r\n!!\r\n@c\n\n+\n"
    (tmp_path / "x.fq").write_bytes(text + b"\n")
    (tmp_path / "y.fq.gz").write_bytes(gzip.compress(text) + gzip.compress(b"\n@d\nG\n+\nI"))
    one = fastq.read_fastq(spark, str(tmp_path / "x.fq")).collect()
    assert [tuple(r) for r in one] == [(0, "@a 1", "ACGT", "+", "IIII"), (1, "@b", "AC", "+b", "!!"), (2, "@c", "", "+", "")]
    assert fastq.read_fastq(spark, str(tmp_path / "y.fq.gz")).count() == 4
    for bad, said in ((b"@a\nAC\n+\nI\n", "record 1"), (b"@a\nA\n+\nI\n@b\nA\n", "record 2: truncated"), (b"a\nA\n+\nI\n", "must start with @")):
        with pytest.raises(fastq.FastqError, match=said):
            list(fastq.records(bad.splitlines(True)))
    assert list(fastq.records([b"@a\n", b"A\n", b"+\n", b"h\n"], phred64=True)) == [(0, "@a", "A", "+", "I")]


def test_pairing_checks_counts(spark, tmp_path):
    (tmp_path / "x.fq").write_bytes(b"@a\nA\n+\nI\n@b\nC\n+\nI\n")
    (tmp_path / "y.fq").write_bytes(b"@a\nG\n+\nI\n")
    x, y = (fastq.read_fastq(spark, str(tmp_path / f)) for f in ("x.fq", "y.fq"))
    assert fastq.pair_files(x, x).count() == 2
    with pytest.raises(Exception, match="different read counts"):
        fastq.pair_files(x, y).collect()
    with pytest.raises(Exception, match="odd number"):
        fastq.pair_interleaved(y).collect()


def test_options_are_checked():
    for bad in ({"umi": True, "umi_loc": "x"}, {"split": 1}, {"split_by_lines": 1002}, {"overlap_len_require": 0}, {"split": 2, "split_by_lines": 1000}):
        with pytest.raises(ValueError):
            Options(**bad).validate()
    assert sinks.split_name(3, "out/a.fq") == "out/0003.a.fq"


def test_written_records_keep_their_order(spark, tmp_path):
    done = ch.chain(reads(spark, SF), Options(disable_adapter_trimming=True))
    out = sinks.routes(done, Options()).where("route = 'out1'")
    sinks.write_fastq(out, str(tmp_path / "o"), "gzip")
    lines = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "o").glob("part-*"))).splitlines(True)
    names = [r[1] for r in fastq.records(lines)]
    assert names == [r["record"].split("\n")[0] for r in out.orderBy("ordinal").collect()]


def test_overrepresented_equals_a_plain_loop(spark):
    r = random.Random(7)
    seqs, (whole, part) = random_reads(1200, 5, low=60, high=150), random_reads(2, 6, low=150, high=150)
    for i in range(0, 1200, 3):
        seqs[i] = whole
        at = r.randrange(30)
        seqs[i + 1] = seqs[i + 1][:at] + part[:30] + seqs[i + 1][at:120]
    ids, table = range(1200), spark.createDataFrame(list(enumerate(seqs)), "ordinal long, seq1 string")
    counts = {}
    for s in seqs:
        for k in (10, 20, 40, 100, 148):
            for i in range(max(0, len(s) - k)):
                counts[s[i : i + k]] = counts.get(s[i : i + k], 0) + 1
    least = {10: 500, 20: 100, 40: 20, 100: 5, 148: 5}
    counts = {s: n for s, n in counts.items() if n >= least[len(s)]}
    assert counts == {r["sequence"]: r["n"] for r in overrep.window_counts(table)[0].collect()}
    for s in sorted(counts):
        if any(s in x and x != s and counts[s] // n < 10 for x, n in counts.items()):
            del counts[s]
    want = {}
    for o, s in zip(ids, seqs, strict=True):
        for k in (10, 20, 40, 100, 148) if o % 2 == 0 else ():
            i = 0
            while i < len(s) - k:
                if s[i : i + k] in counts:
                    want[s[i : i + k]] = want.get(s[i : i + k], 0) + 1
                    i += k
                i += 1
    want = {s: n for s, n in want.items() if 2 * n > {10: 500, 20: 200, 40: 100, 100: 50}.get(len(s), 20)}
    assert want and want == {r["sequence"]: r["n"] for r in overrep.overrepresented(table, sampling=2).collect()}


def test_overrepresented_of_no_reads(spark):
    none = spark.createDataFrame([], "ordinal long, seq1 string")
    assert overrep.overrepresented(none).collect() == []
    odd = spark.createDataFrame([(0, None), (0, ""), (1, "A" * 9), (20, "ACGT" * 30)], "ordinal long, seq1 string")
    assert overrep.overrepresented(odd).count() == 0


def plain_cut_tail(s, q, w=4, mean=20):
    poor = lambda t: sum(ord(x) for x in q[t - w + 1 : t + 1]) < w * (mean + 33)
    if len(s) <= w:
        return "", ""
    t = len(s) - 1
    while t >= w and poor(t):
        t -= 1
    if t < len(s) - 1:
        t = t + 1 - w
    while t >= 0 and s[t] == "N":
        t -= 1
    end = t + 1
    return (s[:end], q[:end]) if end > 0 and len(s) > 1 else ("", "")


def plain_poly_x(s, least=10):
    """Bases that the tail of one base loses."""
    counts, pos = dict.fromkeys("ATCG", 0), len(s)
    for i, b in enumerate(reversed(s)):
        for x in counts:
            counts[x] += b in (x, "N")
        if all(i + 1 - n > min(5, (i + 1) // 8) for n in counts.values()) and (i >= 8 or i + 2 >= least):
            pos = i
            break
    if pos + 1 < least or not s:
        return 0
    base, n = max("ATCG", key=lambda x: counts[x]), min(pos + 1, len(s))
    while n and s[len(s) - n] != base:
        n -= 1
    return n


def plain_reason(s, q):
    if not s:
        return ch.SHORT
    if sum(ord(x) < 33 + 15 for x in q) > 40 * len(s) / 100:
        return ch.QUALITY
    return ch.MANY_N if s.count("N") > 5 else ch.SHORT if len(s) < 15 else 0


def plain_chain(r, adapters):
    """Cut, poly-G, overlap, correction, adapters, dimers, poly-X, filters, in this order, of one pair."""
    s, q, events = [r["seq1"], r["seq2"]], [r["qual1"], r["qual2"]], [0, 0, 0]
    for i in (0, 1):
        s[i], q[i] = plain_cut_tail(s[i], q[i])
        s[i] = plain_poly_g(s[i], 10)
        q[i] = q[i][: len(s[i])]
    found = plain_overlap(*s)
    pair = dict(zip("ACGT", "TGCA", strict=True))
    if found and found[2]:
        o, n, _ = found
        x, y = ([list(z) for z in (s[i], q[i])] for i in (0, 1))
        for k in range(n):
            a, b = k + max(o, 0), len(s[1]) - 1 - k - max(-o, 0)
            if x[0][a] != pair.get(y[0][b], y[0][b]):
                good, bad = 63, 47
                if ord(x[1][a]) >= good and ord(y[1][b]) <= bad:
                    y[0][b], y[1][b] = pair.get(x[0][a], x[0][a]), x[1][a]
                    events[2] += 1
                elif ord(y[1][b]) >= good and ord(x[1][a]) <= bad:
                    x[0][a], x[1][a] = pair.get(y[0][b], y[0][b]), y[1][b]
                    events[2] += 1
        s, q = ["".join(x[0]), "".join(y[0])], ["".join(x[1]), "".join(y[1])]
    for i in (0, 1):
        keep = len(s[i])
        if found and found[0] < 0:
            keep = min(keep, found[1])
            events[0] += len(s[i]) - keep
            events[1] += 1
        elif hit := plain_adapter(s[i], adapters[i], 4):
            keep = hit[0]
            events[0] += hit[1]
            events[1] += 1
        s[i], q[i] = s[i][:keep], q[i][:keep]
    dimer = events[1] and all(len(x) <= 2 for x in s)
    why = []
    for i in (0, 1):
        keep = len(s[i]) - plain_poly_x(s[i])
        s[i], q[i] = s[i][:keep], q[i][:keep]
        why.append(ch.DIMER if dimer else plain_reason(s[i], q[i]))
    return (*s, *q, *why, *events)


def test_full_chain_equals_plain_steps(spark):
    o = Options(correction=True, cut_tail=True, trim_poly_g=True, trim_poly_x=True, adapter_sequence=KNOWN_ADAPTERS[0], adapter_sequence_r2=KNOWN_ADAPTERS[1])
    table = reads(spark, SF).where("ordinal < 700").cache()
    got = ch.chain(table, o).select("ordinal", "seq1", "seq2", "qual1", "qual2", "fail1", "fail2", "adapter_bases", "adapter_reads", "corrected_bases").collect()
    want = {r["ordinal"]: plain_chain(r, KNOWN_ADAPTERS) for r in table.collect()}
    assert {r["ordinal"]: tuple(r)[1:] for r in got} == want
    assert len({w[4:6] for w in want.values()}) > 2 and sum(w[8] for w in want.values())

"""Whole runs, sources, detection, path checks, reports and streams, against plain loops and literals."""

import gzip
import io
import json
import random
import struct
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from readloom import __main__ as cli
from readloom import paths, run, streaming
from readloom.functions import mates
from readloom.operators import adapters, profile, report, sinks
from readloom.operators import chain as ch
from readloom.options import KNOWN_ADAPTERS, Options
from readloom.sources import fastq
from readloom.sources.recipe import reads
from test_reads import batch, plain_overlap, random_reads

SF = "/root/testdata/sf0.001"


def text_of(records):
    return "".join("\n".join(r) + "\n" for r in records).encode()


def some_records(n, seed=1, low=0, high=90):
    r = random.Random(seed)
    return [(f"@r{i} x", s, "+", "".join(r.choice("#5FI@+") for _ in s)) for i, s in enumerate(random_reads(n, seed, low=low, high=high))]


def got(frame):
    return [tuple(r) for r in frame.orderBy("ordinal").select("name", "seq", "plus", "qual").collect()]


# ---- sources ----------------------------------------------------------------------------------


def blocks(data, size=300):
    """data as gzip members that tell their sizes."""
    out = b""
    for i in [*range(0, len(data), size), len(data)]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data[i : i + size]) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[i : i + size]), len(data[i : i + size]))
    return out


def test_splits_of_a_file_are_its_records(spark, tmp_path, monkeypatch):
    """Any split size, blank lines between records, reads without bases, qualities that look like names, CRLF, folders, members with sizes."""
    records = some_records(400)
    plain = b"".join(b"\n" * (i % 3 == 0) + text_of([x]) + b" \n" * (i % 5 == 0) for i, x in enumerate(records))
    (tmp_path / "x.fq").write_bytes(plain.rstrip(b"\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (701, 3000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            table = fastq.scan(spark, str(tmp_path / "x.fq"))
            assert got(table) == records and sorted(r[0] for r in table.select("ordinal").collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.fq").write_bytes(text_of(records[:100]).replace(b"\n", b"\r\n"))
    (folder / "b.fq.gz").write_bytes(gzip.compress(text_of(records[100:150])) + gzip.compress(text_of(records[150:300])))
    (folder / "c.fq").write_bytes(text_of(records[300:]))
    assert got(fastq.scan(spark, str(folder))) == records and got(fastq.scan(spark, f"file://{folder}/*.fq")) == records[:100] + records[300:]
    (tmp_path / "hidden").write_bytes(gzip.compress(plain))
    assert got(fastq.scan(spark, str(tmp_path / "hidden"))) == records
    (tmp_path / "m.fq.gz").write_bytes(blocks(plain))
    for size in (1000, 4096, 1 << 20):
        monkeypatch.setattr(fastq, "RANGE", size)
        assert got(fastq.scan(spark, str(tmp_path / "m.fq.gz"))) == records
    (tmp_path / "empty.fq").write_bytes(b"\n")
    assert fastq.scan(spark, str(tmp_path / "empty.fq")).count() == 0
    with pytest.raises(FileNotFoundError):
        fastq.scan(spark, str(tmp_path / "none.fq"))


def test_errors_name_the_record(spark, tmp_path):
    good = text_of(some_records(30, low=5))
    for bad, said in ((b"@x\nAC\n+\nI\n", "record 31: 2 bases"), (b"@x\nA\n", "record 31: truncated"), (b"x\nA\n+\nI\n", "record 31: a name")):
        (tmp_path / "x.fq").write_bytes(good + bad)
        with pytest.raises(Exception, match=said):
            fastq.scan(spark, str(tmp_path / "x.fq")).collect()


def test_places_at_the_ends_of_splits():
    r = random.Random(4)
    for _ in range(200):
        lines = [r.choice([b"", b" ", b"@a", b"A", b"+"]) for _ in range(r.randrange(12))]
        want = []
        for place in range(4):
            n = 0
            for x in lines:
                if place or x.strip():
                    n, place = n + (place == 3), (place + 1) % 4
            want.append((place, n))
        assert fastq.ends(lines) == want


def test_files_of_sequences(tmp_path):
    (tmp_path / "a.fa").write_text(">one\nacgt\nAC\n\n>two\nGGGGGGG\n")
    (tmp_path / "b.txt").write_text("ACGT\n\n TTTT \n")
    assert fastq.sequences(str(tmp_path / "a.fa"), True) == ("ACGTAC", "GGGGGGG") and fastq.sequences(str(tmp_path / "b.txt"), False) == ("ACGT", "TTTT")
    with pytest.raises(ValueError, match="header"):
        fastq.sequences(str(tmp_path / "b.txt"), True)


# ---- kernels ----------------------------------------------------------------------------------


def plain_gap_overlap(a, b, least, most=5, percent=20):
    rc = b[::-1].translate(str.maketrans("ACGT", "TGCA"))

    def near(ins, normal, n, limit):
        tail = ins[n] != normal[n - 1]
        if (ins[0] != normal[0]) + tail > limit:
            return False
        best = None
        for i in range(1, n):
            left = sum(ins[j] != normal[j] for j in range(i))
            if left + tail > limit:
                return False
            both = left + sum(ins[j + 1] != normal[j] for j in range(i, n))
            best = both if best is None else min(best, both)
        return best is not None and best <= limit

    for o in [*range(max(len(a) - least, 0)), *(-k for k in range(max(len(rc) - least, 0)))]:
        x, y = a[max(o, 0) :], rc[max(-o, 0) :]
        n = min(len(x), len(y))
        limit = min(most, n * percent // 100)
        if n >= 3 and (near(x[:n], y[:n], n - 1, limit) or near(y[:n], x[:n], n - 1, limit)):
            return o, n
    return None


def test_gap_overlap_equals_a_plain_loop():
    r, a, b = random.Random(9), [], []
    for _ in range(250):
        ins = "".join(r.choice("ACGT") for _ in range(r.randint(10, 70)))
        rc = list(ins[::-1].translate(str.maketrans("ACGT", "TGCA")))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(rc))
            rc[k : k + 1] = r.choice([[], [rc[k], "A"], ["C"]])
        a.append((ins + "".join(r.choice("ACGT") for _ in range(30)))[: r.randint(0, 60)])
        b.append(("".join(rc) + "".join(r.choice("ACGT") for _ in range(30)))[: r.randint(0, 60)])
    found, offset, length = mates.gap_overlap(batch(a), batch(b), __import__("numpy").ones(len(a), bool), 15, 5, 20)
    told = [(int(o), int(n)) if f else None for f, o, n in zip(found, offset, length, strict=True)]
    assert told == [plain_gap_overlap(x, y, 15) for x, y in zip(a, b, strict=True)] and any(told) and not all(told)


def test_gap_overlap_trims(spark):
    r, rows = random.Random(2), []
    for i in range(400):
        s = "".join(r.choice("AC") for _ in range(r.randint(14, 26)))
        rc = list(s[::-1].translate(str.maketrans("ACGT", "TGCA")))
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(rc))
            rc[k : k + 1] = r.choice([[], [rc[k], "A"], ["C"], ["G"]])
        one, two = s + "GTTAGG", "".join(rc) + "CATTGA"
        rows.append((i, "@a", one, "+", "I" * len(one), "@a", two, "+", "I" * len(two)))
    o = Options(allow_gap_overlap_trimming=True, overlap_len_require=12, overlap_diff_limit=1, adapter_sequence="TTTTTTTTTTTT")
    table, gaps = ch.chain(spark.createDataFrame(rows, run.RECORD), o).collect(), 0
    for x in table:
        _, _, one, _, _, _, two, *_ = rows[x["ordinal"]]
        plain, gap = plain_overlap(one, two, 12, 1), plain_gap_overlap(one, two, 12, 1)
        use = plain or gap
        gaps += bool(gap and not plain and gap[0] < 0)
        if use and use[0] < 0:
            assert (len(x["seq1"]), len(x["seq2"])) == (min(len(one), use[1]), min(len(two), use[1]))
    assert gaps


# ---- detection --------------------------------------------------------------------------------


def test_known_and_new_adapters_are_detected():
    r = random.Random(3)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    new = dna(100)
    plain = [dna(100) for _ in range(12000)]
    known = [dna(r.randint(30, 100)) + KNOWN_ADAPTERS[2] + dna(40) if i % 20 == 0 else s for i, s in enumerate(plain)]
    other = [new if i % 3 == 0 else s for i, s in enumerate(plain)]
    assert adapters.detect([s[:100] for s in known], KNOWN_ADAPTERS) == KNOWN_ADAPTERS[2]
    found = adapters.detect(other, KNOWN_ADAPTERS)
    assert found == new[:60] and adapters.discover(other, (new[:20],), 1) == new[:20]
    assert adapters.detect(plain, KNOWN_ADAPTERS) is None and adapters.detect(other[:9999], KNOWN_ADAPTERS) is None


def test_seed_counts_and_places_equal_plain_loops():
    seqs = random_reads(300, 8, bases="ACGTN", low=0, high=70) + ["", "A" * 60]
    for shift in (1, 4):
        want = {}
        for s in seqs:
            for i in range(20, len(s) - 10 - shift + 1):
                if "N" not in (k := s[i : i + 10]):
                    want[k] = want.get(k, 0) + 1
        counts = adapters.seed_counts(seqs, shift)
        assert {"".join("ATCG"[x >> (2 * i) & 3] for i in range(9, -1, -1)): int(counts[x]) for x in counts.nonzero()[0].tolist()} == want
    a = "ACGTTGCAACGGTACCAT"
    seqs = [s + a[: random.Random(i).randint(5, 18)] for i, s in enumerate(random_reads(300, 5, high=40))]
    want = []
    for s in seqs:
        fits = [d for p in range(max(0, len(s) - 8)) if (d := sum(x != y for x, y in zip(s[p:], a, strict=False))) <= min(len(s) - p, len(a)) // 16]
        want.append(fits[0] if fits and len(s) > len(a) else -1)
    assert adapters.matches(seqs, a).tolist() == want


def test_first_reads_resolve_options(spark):
    rows = [(0, "@NB500 1:N:0:A", "ACGT", "+", "IIII", None, None, None, None)]
    table = spark.createDataFrame(rows, run.RECORD)
    told = adapters.resolve(table, Options(in1="x", adapter_sequence="auto"))
    assert told.trim_poly_g and told.adapter_sequence is None
    assert not adapters.resolve(table, Options(in1="x", disable_trim_poly_g=True)).trim_poly_g and not adapters.resolve(table, Options(in1="-")).trim_poly_g
    both = adapters.resolve(table, Options(in1="x", in2="y", adapter_sequence="acgtacgt"))
    assert both.adapter_sequence == both.adapter_sequence_r2 == "ACGTACGT"
    assert adapters.resolve(table, Options(in1="x", in2="y", adapter_sequence="ACGT", detect_adapter_for_pe=True)).adapter_sequence_r2 is None


# ---- options and paths ------------------------------------------------------------------------


def test_options_that_do_not_go_together():
    pair = {"in1": "a", "in2": "b"}
    for bad in (
        {}, {**pair, "interleaved_in": True}, {"in1": "-", "in2": "-"}, {"in1": "a", "out2": "x"}, {**pair, "out1": "x"}, {**pair, "merge": True, "split": 3, "merged_out": "m"}, {"in1": "a", "merge": True},
        {**pair, "merge": True}, {**pair, "include_unmerged": True}, {"in1": "a", "trim_poly_g": True, "disable_trim_poly_g": True}, {"in1": "-", "split": 3}, {"in1": "a", "stdout": True, "split": 3},
        {"in1": "a", "stats_format": "x"}, {"in1": "a", "adapter_sequence": "ACN"}, {"in1": "a", "adapter_fasta": ("ACGT",)}, {"in1": "a", "average_qual": 94}, {"in1": "a", "cut_tail_window_size": 0},
    ):
        with pytest.raises(ValueError):
            Options(**bad).validate_run()
    o = Options(**pair, merge=True, out1="m").validate_run()
    assert o.correction and o.merged_out == "m" and o.out1 is None
    o = Options(**pair, merge=True, merged_out="m", include_unmerged=True, out1="x", out2="y", unpaired1="u").validate_run()
    assert (o.out1, o.out2, o.unpaired1) == (None, None, None)
    assert Options(in1="a", unpaired1="u", overlapped_out="v", merged_out="m", out1="/dev/stdout").validate_run().stdout


def test_outputs_may_not_destroy_anything(tmp_path):
    at = lambda n: str(tmp_path / n)
    for n in ("in.fq", "0002.o.fq", "old.fq"):
        (tmp_path / n).write_text("")
    (tmp_path / "link.fq").symlink_to(tmp_path / "in.fq")
    (tmp_path / "dangling.fq").symlink_to(tmp_path / "later.fq")
    (tmp_path / "hard.fq").hardlink_to(tmp_path / "in.fq")
    (tmp_path / "a").symlink_to("b")
    (tmp_path / "b").symlink_to("a")
    base = {"in1": at("in.fq"), "json": at("r.json"), "html": at("r.html")}
    for bad in (
        {"out1": at("in.fq")}, {"out1": at("link.fq")}, {"out1": at("hard.fq")}, {"out1": at("r.json")}, {"out1": at("dangling.fq"), "failed_out": at("later.fq")}, {"out1": str(tmp_path)}, {"out1": at("a")},
        {"out1": at("old.fq"), "dont_overwrite": True}, {"out1": at("o.fq"), "split": 3, "dont_overwrite": True}, {"out1": at("o.fq"), "split": 3, "failed_out": at("0001.o.fq")},
        {"out1": at("o.fq"), "split_by_lines": 1000, "in1": at("0002.o.fq")},
    ):
        with pytest.raises((ValueError, OSError)):
            paths.check(Options(**(base | bad)).normalized())
    for good in ({"out1": at("old.fq")}, {"out1": at("o.fq"), "split": 3}, {"out1": at("o.fq"), "split": 2, "failed_out": at("0003.o.fq")}, {"in2": at("old.fq"), "out1": at("x"), "out2": at("y"), "unpaired1": at("u"), "unpaired2": at("u")}):
        paths.check(Options(**(base | good)).normalized())


# ---- runs -------------------------------------------------------------------------------------


def plain_details(seqs):
    """Totals, curves and 5-mers of (seq, qual) pairs."""
    longest = max((len(s) for s, _ in seqs), default=0)
    q = [ord(c) - 33 for _, x in seqs for c in x]
    mean, gc, kmers = [], [], {}
    for i in range(longest):
        own = [(s[i], ord(x[i]) - 33) for s, x in seqs if len(s) > i]
        mean.append(sum(b for _, b in own) / len(own))
        gc.append(sum(a in "GC" for a, _ in own) / len(own))
    for s, _ in seqs:
        for i in range(len(s) - 4):
            kmers[s[i : i + 5]] = kmers.get(s[i : i + 5], 0) + 1
    return {"total_reads": len(seqs), "total_bases": len(q), "q30_bases": sum(x >= 30 for x in q), "total_cycles": longest}, mean, gc, {k: n for k, n in kmers.items() if not set(k) - set("ACGT")}


def same_details(told, seqs):
    totals, mean, gc, kmers = plain_details(seqs)
    assert {k: told[k] for k in totals} == totals
    assert told["quality_curves"]["mean"] == pytest.approx(mean) and told["content_curves"]["GC"] == pytest.approx(gc)
    assert len(told["kmer_count"]) in (0, 1024) and {k: n for k, n in told["kmer_count"].items() if n} == kmers


def test_a_run_from_files_to_files(spark, tmp_path):
    table = reads(spark, SF).where("ordinal < 900").cache()
    rows = table.orderBy("ordinal").collect()
    for i in (1, 2):
        (tmp_path / f"r{i}.fq").write_bytes(text_of([(r[f"name{i}"], r[f"seq{i}"], r[f"plus{i}"], r[f"qual{i}"]) for r in rows]))
    at = lambda n: str(tmp_path / n)
    argv = ["-i", at("r1.fq"), "-I", at("r2.fq"), "-o", at("o1.fq.gz"), "--out2", at("o2.fq"), "--unpaired1", at("u.fq"), "--failed-out", at("f.fq"), "-j", at("r.json"), "-h", at("r.html"), "-A", "-x", "-D", "-R", "<b>mine</b>", "-w", "3"]
    done = run.execute(spark, cli.options(argv))
    told = json.loads((tmp_path / "r.json").read_text())
    o = Options(disable_adapter_trimming=True, trim_poly_x=True)
    chained = {r["ordinal"]: r for r in ch.chain(table, o).collect()}
    seen, passed, failed, alone = {}, [], [], []
    for r in rows:
        c, key = chained[r["ordinal"]], (r["seq1"] + r["seq2"]).translate(str.maketrans("RYKMSWBDHV", "N" * 10))
        dup = seen.setdefault(key, r["ordinal"]) != r["ordinal"]
        if not dup:
            ok = (c["fail1"] == 0, c["fail2"] == 0)
            passed += [c] if all(ok) else []
            alone += [c["name1"]] if ok == (True, False) else [c["name2"]] if ok == (False, True) else []
            failed += [f"{c['name2']} {sinks.TAGS[c['fail2']]}"] if ok == (True, False) else [f"{c['name1']} {sinks.TAGS[c['fail1']]}"] if ok == (False, True) else []
    with gzip.open(at("o1.fq.gz")) as f:
        assert [x[1] for x in fastq.records(f)] == [c["name1"] for c in passed]
    names = lambda n: [x[1] for x in fastq.records(io.BytesIO((tmp_path / n).read_bytes()))]
    assert names("o2.fq") == [c["name2"] for c in passed] and names("u.fq") == alone and names("f.fq") == failed and alone
    assert told["duplication"]["rate"] == pytest.approx(1 - len(seen) / len(rows)) and done.records == len(rows)
    for i in (1, 2):
        same_details(told[f"read{i}_before_filtering"], [(r[f"seq{i}"], r[f"qual{i}"]) for r in rows])
        same_details(told[f"read{i}_after_filtering"], [(c[f"seq{i}"], c[f"qual{i}"]) for c in passed])
    assert sum(told["filtering_result"].values()) == 2 * len(rows) and told["filtering_result"]["passed_filter_reads"] == done.passed
    assert told["polyx_trimming"]["total_polyx_trimmed_bases"] == sum(c["polyx_n1"] + c["polyx_n2"] for c in chained.values())
    page = (tmp_path / "r.html").read_text()
    assert "&lt;b&gt;mine&lt;/b&gt;" in page and "<b>mine" not in page and "<script" not in page
    assert cli.main([*argv, "--dont_overwrite"]) == 1 and cli.main(["-o", "x"]) == 2


def test_split_files_and_stdout(spark, tmp_path, monkeypatch):
    (tmp_path / "r.fq").write_bytes(text_of(some_records(700, low=40)))
    at = lambda n: str(tmp_path / n)
    quiet = {"disable_quality_filtering": True, "disable_adapter_trimming": True, "stats_format": "off", "html": ""}
    done = run.process(spark, at("r.fq"), at("o.fq"), split=3, **quiet)
    assert done.files["out1"] == [at(f"000{i}.o.fq") for i in (1, 2, 3)] and [len((tmp_path / f"000{i}.o.fq").read_bytes().splitlines()) // 4 for i in (1, 2, 3)] == [233, 233, 234]
    run.process(spark, at("r.fq"), at("p.fq"), split_by_lines=1000, split_prefix_digits=0, **quiet)
    assert [len((tmp_path / f"{i}.p.fq").read_bytes().splitlines()) for i in (1, 2, 3)] == [1000, 1000, 800]
    out = io.StringIO()
    monkeypatch.setattr(sys, "stdout", out)
    run.process(spark, at("r.fq"), None, interleaved_in=True, stdout=True, **quiet)
    assert [x[1] for x in fastq.records(out.getvalue().encode().splitlines(True))] == [r[0] for r in some_records(700, low=40)]


def test_standard_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": io.BytesIO(text_of(some_records(50, low=20)))}))
    done = run.process(spark, "-", str(tmp_path / "o.fq"), disable_quality_filtering=True, json=str(tmp_path / "j"), html=str(tmp_path / "h"))
    assert done.records == done.passed == 50


def test_records_in_memory(spark):
    single = some_records(60, low=30)
    out, told = run.process_records(spark, single, disable_quality_filtering=True)
    assert out["out1"] == ["\n".join(r) for r in single] and told["summary"]["after_filtering"]["total_reads"] == 60
    out, told = run.process_records(spark, list(zip(single[::2], single[1::2], strict=True)), disable_quality_filtering=True, overlapped_out=True, merge=True, merged_out="m")
    assert len(out.get("out1", [])) + told["merged_pairs"] == 30 and told["merged_and_filtered"]["total_reads"] == told["merged_pairs"]
    out, told = run.process_records(spark, [])
    assert out == {} and told["summary"]["before_filtering"]["total_reads"] == 0 and told["read1_before_filtering"]["quality_curves"]["mean"] == []
    assert report.as_json(told).count("\n") == 0 and report.as_json(told, "jsonl").endswith("\n") and json.loads(report.as_json(told, "pretty")) == told


def test_duplicates_are_dropped_from_outputs_but_not_from_overlaps(spark):
    s = "ACGTTGCAACGGTTACCATG" * 4
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    pair = (("@a", s, "+", "I" * 80), ("@a", rc, "+", "I" * 80))
    out, told = run.process_records(spark, [pair, pair], dedup=True, overlapped_out=True)
    assert len(out["out1"]) == 1 and len(out["overlapped"]) == 2
    assert told["filtering_result"]["passed_filter_reads"] == 4 and told["summary"]["after_filtering"]["total_reads"] == 2


def test_after_population_of_merging(spark):
    table = reads(spark, SF).where("ordinal < 600")
    for more in (False, True):
        o = Options(merge=True, include_unmerged=more)
        want = []
        for r in ch.chain(table, o).collect():
            if r["merged_seq"] is not None:
                want += [r["merged_seq"]] if r["fail1"] == 0 else []
            elif more:
                want += [r[f"seq{i}"] for i in (1, 2) if r[f"fail{i}"] == 0]
        rows = profile.after(ch.chain(table, o), o).collect()
        assert sorted(r["seq"] for r in rows) == sorted(want) and {r["mate"] for r in rows} == {1}


def test_streams_of_files(spark, tmp_path):
    pairs = some_records(200, low=40)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_bytes(text_of(pairs[:120]))
    (tmp_path / "in" / "b.fq.gz").write_bytes(gzip.compress(text_of(pairs[120:])))
    (tmp_path / "in" / "c.fq").write_bytes(text_of(pairs[:20]))
    (tmp_path / "in" / "d.fq").write_bytes(b"")
    stream = streaming.read_stream(spark, str(tmp_path / "in"), interleaved=True, max_files=1)
    o = Options(disable_quality_filtering=True)
    for name, frame in (("done", streaming.process_stream(stream, o)), ("distinct", streaming.distinct(stream))):
        q = frame.writeStream.format("memory").queryName(f"stream_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r[0] for r in spark.table("stream_done").select("name1").collect()) == sorted(r[0] for r in pairs[::2] + pairs[:20:2])
    assert sorted(r[0] for r in spark.table("stream_distinct").select("name2").collect()) == sorted(r[0] for r in pairs[1::2])
    assert spark.table("stream_done").where(F.col("fail1") == 0).count() == 110

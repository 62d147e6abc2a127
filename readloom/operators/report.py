"""The run's report: a tree of plain values for JSON, and a page for people.

Every figure is an aggregate of tables that `profile` makes; what comes to the driver are their rows, of which there are as many as cycles, qualities
and k-mers, whatever the number of reads.

Defined results: no reads give zeros and empty curves; rates of nothing are 0; a mean length is a whole number, rounded down.
"""

from __future__ import annotations

import html
import json
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import overrep, profile
from readloom.operators.chain import REASONS
from readloom.options import Options

#: Fixed value: the release of the upstream tool whose results these are.
COMPATIBILITY = "1.4.0"
#: What the report calls the reasons.
FILTERED = {"passed_filter": "passed_filter_reads", "low_quality": "low_quality_reads", "too_many_N": "too_many_N_reads", "too_short": "too_short_reads", "too_long": "too_long_reads", "low_complexity": "low_complexity_reads", "adapter_dimer": "adapter_dimer_reads"}
LEVELS = (20, 30, 40)


def rate(x: int, of: int) -> float:
    return x / of if of else 0.0


class Profile:
    """Totals, cycles, qualities and k-mers of one stage and mate."""

    def __init__(self):
        self.reads = self.bases = self.longest = 0
        self.cycles: dict[int, dict[str, tuple[int, int]]] = defaultdict(dict)
        self.quality: dict[int, int] = {}
        self.kmers: dict[str, int] = {}
        self.over: dict[str, int] = {}

    def above(self, q: int) -> int:
        return sum(n for level, n in self.quality.items() if level >= q)

    def of(self, base: str) -> int:
        return sum(c.get(base, (0, 0))[0] for c in self.cycles.values())

    def curves(self) -> tuple[dict, dict]:
        quality, content = {b: [] for b in ("A", "T", "C", "G", "mean")}, {b: [] for b in ("A", "T", "C", "G", "N", "GC")}
        for i in range(self.longest):
            here = self.cycles.get(i, {})
            n, total = (sum(x[k] for x in here.values()) for k in (0, 1))
            mean = rate(total, n)
            quality["mean"].append(mean)
            for b in "ATCG":
                count, qualities = here.get(b, (0, 0))
                quality[b].append(qualities / count if count else mean)
                content[b].append(rate(count, n))
            known = sum(here.get(b, (0, 0))[0] for b in "ATCG")
            content["N"].append(rate(n - known, n))
            content["GC"].append(rate(sum(here.get(b, (0, 0))[0] for b in "GC"), n))
        return quality, content

    def details(self) -> dict:
        quality, content = self.curves()
        return {
            "total_reads": self.reads, "total_bases": self.bases, **{f"q{q}_bases": self.above(q) for q in LEVELS}, "total_cycles": self.longest,
            "quality_curves": quality, "content_curves": content, "qual_hist": {str(q): n for q, n in sorted(self.quality.items()) if n} or None,
            "kmer_count": dict(sorted(self.kmers.items())), "overrepresented_sequences": dict(sorted(self.over.items())),
        }


def summary(mates: list[Profile], paired: bool) -> dict:
    reads, bases = sum(m.reads for m in mates), sum(m.bases for m in mates)
    high = {q: sum(m.above(q) for m in mates) for q in LEVELS}
    means = {f"read{i}_mean_length": m.bases // m.reads if m.reads else 0 for i, m in enumerate(mates, 1) if i == 1 or paired}
    return {
        "total_reads": reads, "total_bases": bases, **{f"q{q}_bases": n for q, n in high.items()}, **{f"q{q}_rate": rate(n, bases) for q, n in high.items()},
        **means, "gc_content": rate(sum(m.of("G") + m.of("C") for m in mates), bases),
    }


def profiles(rows: DataFrame, kmers: bool) -> dict[tuple[str, int], Profile]:
    """By stage and mate; three aggregations over all rows at once."""
    out: dict[tuple[str, int], Profile] = defaultdict(Profile)
    for r in profile.totals(rows).collect():
        own = out[r["stage"], r["mate"]]
        own.reads, own.bases, own.longest = r["reads"], r["bases"], r["max_len"]
    for r in profile.counts(rows).collect():
        own = out[r["stage"], r["mate"]]
        if r["kind"] == "qual":
            own.quality[r["code"]] = r["n"]
        else:
            own.cycles[r["cycle"]][chr(r["code"])] = (r["n"], r["qsum"])
    for r in profile.kmers(rows).collect() if kmers else ():
        out[r["stage"], r["mate"]].kmers[r["kmer"]] = r["n"]
    return out


def build(raw: DataFrame, done: DataFrame, o: Options, paired: bool, version: str) -> dict:
    """The report of a run: raw are the records as they were read, done what the chain made of them (with `duplicate`, if that was told)."""
    passed = profile.after(done, o)
    found = profiles(profile.long_form(raw).unionByName(passed), not o.no_kmer)
    if o.overrepresentation_analysis:
        for i in (1, 2) if paired else (1,):
            for stage, told in overrep.both(raw, passed, i, o.overrepresentation_sampling).items():
                found[stage, i].over = told
    before, after = ([found[stage, i] for i in (1, 2)] for stage in ("before", "after"))
    cycles = f"paired end ({before[0].longest} cycles + {before[1].longest} cycles)" if paired else f"single end ({before[0].longest} cycles)"
    failed = {r["reason"]: r["reads"] for r in profile.failure_counts(done, o).collect()}
    events = profile.event_totals(done, o).first()
    out = {
        "summary": {"version": version, "compatibility_version": COMPATIBILITY, "sequencing": cycles, "before_filtering": summary(before, paired), "after_filtering": summary(after, paired and not o.merge)},
        "filtering_result": {FILTERED[x]: failed.get(x, 0) for x in (REASONS[0], REASONS[4], *REASONS[1:4], *REASONS[5:])},
    }
    if o.corrects:
        out["filtering_result"] |= {"corrected_reads": events["corrected_reads"], "corrected_bases": events["corrected_bases"]}
    if "duplicate" in done.columns:
        out["duplication"] = {"rate": rate(done.where("duplicate").count(), events["records"])}
    if not o.disable_adapter_trimming:
        out["adapter_cutting"] = {"adapter_trimmed_reads": events["adapter_reads"], "adapter_trimmed_bases": events["adapter_bases"]}
    if o.trim_poly_x:
        reads, bases = ([events[f"polyx_{k}_{b}"] for b in "ATCG"] for k in ("reads", "bases"))
        out["polyx_trimming"] = {"total_polyx_trimmed_reads": sum(reads), "total_polyx_trimmed_bases": sum(bases), "polyx_trimmed_reads": reads, "polyx_trimmed_bases": bases}
    if paired:
        sizes = {r["size"]: r["n"] for r in profile.insert_sizes(done).collect()}
        out["insert_size"] = {**profile.insert_peak(done).first().asDict(), "histogram": [sizes.get(i, 0) for i in range(512)]}
    for stage, mates in (("before", before), ("after", after)):
        for i in (1, 2) if paired else (1,):
            out[f"read{i}_{stage}_filtering"] = mates[i - 1].details()
    if o.merge:
        out |= {"merged_and_filtered": after[0].details(), "merged_pairs": events["merged_pairs"]}
    return out


def as_json(report: dict, form: str = "compact") -> str:
    """compact, pretty, or jsonl: compact with a line's end."""
    return json.dumps(report, indent=2) if form == "pretty" else json.dumps(report, separators=(",", ":")) + "\n" * (form == "jsonl")


# ---- the page ---------------------------------------------------------------------------------

_STYLE = "body{font:15px sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #bbb;padding:.2em .6em;text-align:right}th{text-align:left}svg{width:100%;height:220px;border:1px solid #ddd}pre{white-space:pre-wrap}"
_COLOURS = {"A": "#5779A3", "T": "#D1605E", "C": "#6A9F58", "G": "#E49444", "N": "#7C7C7C", "GC": "#222222", "mean": "#222222", "n": "#5779A3"}


def _text(x) -> str:
    return html.escape(f"{x:,}" if isinstance(x, int) else f"{x:.4f}" if isinstance(x, float) else str(x), quote=True)


def _table(title: str, rows: dict) -> str:
    return f"<h2>{_text(title)}</h2><table>" + "".join(f"<tr><th>{_text(k)}</th>" + "".join(f"<td>{_text(x)}</td>" for x in (v if isinstance(v, (list, tuple)) else [v])) + "</tr>" for k, v in rows.items()) + "</table>"


def _plot(title: str, curves: dict[str, list[float]]) -> str:
    longest, most = max(map(len, curves.values()), default=0), max((max(c, default=0) for c in curves.values()), default=0) or 1
    lines = [f'<polyline fill="none" stroke="{_COLOURS.get(k, "#555")}" points="' + " ".join(f"{900 * i / max(longest - 1, 1):.1f},{200 - 190 * y / most:.1f}" for i, y in enumerate(c)) + f'"><title>{_text(k)}</title></polyline>' for k, c in curves.items()]
    names = " ".join(f'<span style="color:{_COLOURS.get(k, "#555")}">{_text(k)}</span>' for k in curves)
    return f'<h3>{_text(title)}</h3><p>{names}; up to {_text(float(most))}</p><svg viewBox="0 0 900 210" preserveAspectRatio="none">{"".join(lines)}</svg>'


def as_html(report: dict, o: Options, command: str = "") -> str:
    """A page without scripts; everything that comes from names, options or data is escaped."""
    s = report["summary"]
    both = {k: (s["before_filtering"][k], s["after_filtering"].get(k, "")) for k in s["before_filtering"]}
    parts = [f"<h1>{_text(o.report_title)}</h1><p>{_text(s['sequencing'])}; version {_text(s['version'])}, compatible with {_text(s['compatibility_version'])}</p>", _table("Before and after filtering", both), _table("Filtering result", report["filtering_result"])]
    parts += [_table(title, report[k]) for k, title in (("duplication", "Duplication"), ("adapter_cutting", "Adapters"), ("polyx_trimming", "Poly-X trimming")) if k in report]
    if "insert_size" in report:
        own = report["insert_size"]
        parts.append(_plot(f"Insert sizes (peak {own['peak']}, unknown {own['unknown']})", {"n": own["histogram"]}))
    if "merged_pairs" in report:
        parts.append(_table("Merged pairs", {"merged_pairs": report["merged_pairs"]}))
    for key in sorted(k for k in report if k.endswith("_filtering") or k == "merged_and_filtered"):
        own = report[key]
        parts += [f"<h2>{_text(key)}</h2>", _plot("Quality by cycle", own["quality_curves"]), _plot("Content by cycle", own["content_curves"])]
        hist = own["qual_hist"] or {}
        parts.append(_plot("Qualities", {"n": [hist.get(str(q), 0) for q in range(94)]}))
        if own["kmer_count"]:
            top = sorted(own["kmer_count"].items(), key=lambda x: (-x[1], x[0]))[:20]
            parts.append(_table("Most frequent 5-mers", dict(top)))
        if own["overrepresented_sequences"]:
            parts.append(_table("Over-represented sequences", own["overrepresented_sequences"]))
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{_text(o.report_title)}</title><style>{_STYLE}</style></head><body>{"".join(parts)}<pre>{_text(command)}</pre></body></html>'

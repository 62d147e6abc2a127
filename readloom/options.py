"""Run options: names, defaults and value rules of the preprocessing chain."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Adapters that detection knows unless it is given others. A longer list is a parameter (`known_adapters`, a FASTA file on the command line).
KNOWN_ADAPTERS = (
    "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA",
    "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT",
    "CTGTCTCTTATACACATCT",
    "TGGAATTCTCGGGTGCCAAGG",
)


@dataclass(frozen=True)
class Options:
    # filters
    length_required: int = 15
    length_limit: int = 0
    disable_length_filtering: bool = False
    qualified_quality_phred: int = 15
    unqualified_percent_limit: int = 40
    average_qual: int = 0
    n_base_limit: int = 5
    disable_quality_filtering: bool = False
    low_complexity_filter: bool = False
    complexity_threshold: int = 30
    # fixed trims
    trim_front: int = 0
    trim_tail: int = 0
    trim_front1: int = 0
    trim_tail1: int = 0
    trim_front2: int | None = None
    trim_tail2: int | None = None
    max_len1: int = 0
    max_len2: int | None = None
    # quality cuts
    cut_front: bool = False
    cut_tail: bool = False
    cut_right: bool = False
    disable_trim_tail: bool = False
    cut_window_size: int = 4
    cut_mean_quality: int = 20
    cut_front_window_size: int | None = None
    cut_front_mean_quality: int | None = None
    cut_tail_window_size: int | None = None
    cut_tail_mean_quality: int | None = None
    cut_right_window_size: int | None = None
    cut_right_mean_quality: int | None = None
    # homopolymer tails
    trim_poly_g: bool = False
    disable_trim_poly_g: bool = False
    poly_g_min_len: int = 10
    trim_poly_x: bool = False
    poly_x_min_len: int = 10
    # adapters and overlap
    disable_adapter_trimming: bool = False
    adapter_sequence: str | None = None
    adapter_sequence_r2: str | None = None
    adapter_fasta: tuple[str, ...] = ()
    detect_adapter_for_pe: bool = False
    disable_adapter_detection: bool = False
    allow_gap_overlap_trimming: bool = False
    dimer_max_len: int = 2
    correction: bool = False
    overlap_len_require: int = 30
    overlap_diff_limit: int = 5
    overlap_diff_percent_limit: int = 20
    merge: bool = False
    include_unmerged: bool = False
    overlapped_out: str | bool | None = False
    # names
    umi: bool = False
    umi_loc: str = ""
    umi_len: int = 0
    umi_prefix: str = ""
    umi_skip: int = 0
    umi_delim: str = ":"
    fix_mgi_id: bool = False
    filter_by_index1: tuple[str, ...] = ()
    filter_by_index2: tuple[str, ...] = ()
    filter_by_index_threshold: int = 0
    # whole run
    dedup: bool = False
    dup_calc_accuracy: int = 0
    dont_eval_duplication: bool = False
    reads_to_process: int = 0
    phred64: bool = False
    no_kmer: bool = False
    overrepresentation_analysis: bool = False
    overrepresentation_sampling: int = 20
    split: int | None = None
    split_by_lines: int | None = None
    split_prefix_digits: int = 4
    report_title: str = "readloom report"
    # inputs and outputs
    in1: str = ""
    in2: str | None = None
    interleaved_in: bool = False
    stdin: bool = False
    stdout: bool = False
    out1: str | None = None
    out2: str | None = None
    unpaired1: str | None = None
    unpaired2: str | None = None
    merged_out: str | None = None
    failed_out: str | None = None
    json: str = "readloom.json"
    html: str = "readloom.html"
    stats_format: str = "compact"
    compression: int = 4
    dont_overwrite: bool = False
    verbose: bool = False
    known_adapters: tuple[str, ...] = KNOWN_ADAPTERS

    @property
    def paired(self) -> bool:
        return self.in2 is not None or self.interleaved_in

    def normalized(self) -> "Options":
        """These options as a run takes them: what one sets or clears in others."""
        new = {"umi_loc": self.umi_loc.lower()}
        new["in1"] = source = "-" if self.stdin or self.in1 == "/dev/stdin" else self.in1
        out1 = "-" if self.out1 == "/dev/stdout" else self.out1
        stdout = self.stdout or out1 == "-"
        out2, merged, un1, un2 = self.out2, self.merged_out, self.unpaired1, self.unpaired2
        if self.merge:
            new["correction"] = True
            if not merged and not stdout and out1 and not out2:
                merged, out1 = out1, None
            if self.include_unmerged:
                out1 = out2 = un1 = un2 = None
        if stdout:
            out1 = out2 = None
        if not self.paired:
            un1 = un2 = None
            new["overlapped_out"] = None
        new |= {"in1": source, "stdout": stdout, "out1": out1, "out2": out2, "unpaired1": un1, "unpaired2": un2, "merged_out": merged if self.merge else None}
        return replace(self, **new)

    def validate_run(self) -> "Options":
        """Normalised options, if they go together; else ValueError. Values are checked too."""
        o = self.normalized()
        rules = [
            (bool(o.in1), "an input is required"),
            (not (o.interleaved_in and o.in2), "interleaved_in excludes in2"),
            (not (o.in1 == "-" and o.in2 == "-"), "paired standard input must be interleaved"),
            (o.paired or not o.out2, "out2 needs paired reads"),
            (o.stdout or not o.paired or bool(o.out1) == bool(o.out2), "paired output needs both out1 and out2"),
            (not (o.merge and (o.split or o.split_by_lines)), "merge and split exclude each other"),
            (not o.merge or o.merged_out or o.stdout, "merge needs merged_out or stdout"),
            (not o.include_unmerged or o.merge, "include_unmerged needs merge"),
            (not (o.trim_poly_g and o.disable_trim_poly_g), "trim_poly_g and disable_trim_poly_g exclude each other"),
            (o.poly_g_min_len > 0 and o.poly_x_min_len > 0, "poly_g_min_len and poly_x_min_len must be positive"),
            (o.stats_format in ("compact", "pretty", "jsonl", "off"), "stats_format is unknown"),
            (not (o.split and o.in1 == "-"), "standard input cannot be split by a number of files"),
            (not (o.stdout and (o.split or o.split_by_lines)), "standard output cannot be split"),
            (1 <= o.compression <= 9, "compression must be 1-9"),
            (all(a is None or a == "auto" or (len(a) >= 4 and not a.upper().strip("ACGT")) for a in (o.adapter_sequence, o.adapter_sequence_r2)), "an adapter needs at least four of A, C, G, T and nothing else"),
            (all(len(a) >= 6 and not a.strip("ACGT") for a in o.adapter_fasta), "a FASTA adapter needs at least six of A, C, G, T and nothing else"),
        ]
        for good, said in rules:
            if not good:
                raise ValueError(said)
        return o.validate(o.paired)

    def validate(self, paired: bool = True) -> "Options":
        """These options, if their values are allowed; else ValueError."""
        windows = [getattr(self, f"cut_{k}_window_size") for k in ("front", "tail", "right")]
        levels = [getattr(self, f"cut_{k}_mean_quality") for k in ("front", "tail", "right")]
        rules = [
            (all(1 <= w <= 1000 for w in windows if w is not None), "a cut's window must be 1-1000"),
            (all(1 <= q <= 36 for q in levels if q is not None), "a cut's mean quality must be 1-36"),
            (0 <= self.average_qual <= 93, "average_qual must be 0-93"),
            (0 <= self.qualified_quality_phred <= 93, "qualified_quality_phred must be 0-93"),
            (0 <= self.unqualified_percent_limit <= 100, "unqualified_percent_limit must be 0-100"),
            (0 <= self.complexity_threshold <= 100, "complexity_threshold must be 0-100"),
            (0 <= self.overlap_diff_percent_limit <= 100, "overlap_diff_percent_limit must be 0-100"),
            (self.overlap_len_require > 0, "overlap_len_require must be positive"),
            (1 <= self.cut_window_size <= 1000, "cut_window_size must be 1-1000"),
            (1 <= self.cut_mean_quality <= 36, "cut_mean_quality must be 1-36"),
            (0 <= self.dup_calc_accuracy <= 6, "dup_calc_accuracy must be 0-6"),
            (not self.umi or self.umi_loc in ("index1", "index2", "read1", "read2", "per_index", "per_read"), "umi_loc is unknown"),
            (not self.umi or self.umi_loc.endswith("index") or self.umi_loc[:-1] == "index" or self.umi_len > 0, "umi_len must be positive for a UMI in reads"),
            (not self.umi or paired or self.umi_loc not in ("index2", "read2"), "umi_loc needs paired reads"),
            (not self.merge or paired, "merge needs paired reads"),
            (self.split is None or 2 <= self.split <= 999, "split must be 2-999"),
            (self.split_by_lines is None or (self.split_by_lines >= 1000 and self.split_by_lines % 4 == 0), "split_by_lines must be at least 1000 and a multiple of 4"),
            (self.split is None or self.split_by_lines is None, "split and split_by_lines exclude each other"),
            (0 <= self.split_prefix_digits <= 10, "split_prefix_digits must be 0-10"),
            (1 <= self.overrepresentation_sampling <= 10000, "overrepresentation_sampling must be 1-10000"),
        ]
        for good, said in rules:
            if not good:
                raise ValueError(said)
        return self

    @property
    def corrects(self) -> bool:
        return self.correction or self.merge

    def cut(self, kind: str) -> tuple[int, int]:
        """Window and mean quality of a cut, with the common values where it has none of its own."""
        window, quality = getattr(self, f"cut_{kind}_window_size"), getattr(self, f"cut_{kind}_mean_quality")
        return window if window is not None else self.cut_window_size, quality if quality is not None else self.cut_mean_quality

"""License scans: phrases, and template markup compiled to token automata.

A template is text with `<<beginOptional>> ... <<endOptional>>` regions and `<<var;match=LO..HI>>` replaceable regions
of so many words. It compiles to a nondeterministic automaton over words: a word advances one state, a region may be
skipped, a replaceable region takes any words within its bounds. A passage is accepted only if its mandatory
wording matches word for word. An automaton runs only around the places of its anchor (its longest run of mandatory
words), which every accepted passage contains.

Defined results: null and empty texts have no words (`first_word`, `last_word` null, empty labels, score 0). Repeated
rows each give their own row; null doc_ids are kept; further columns are not read, whatever their names; of passages that end at one word the longest is
told; a text of any length takes time in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import ship

#: The phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=1..12>>
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions
in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY <<var;match=1..12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=1..12>> BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Wordings of well-known licenses and notices, with their identifiers.
TEMPLATES = {
    "mit": f"""<<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;match=1..20>><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
substantial portions of the Software. {_AS_IS}""",
    "mit-short": "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "isc": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=1..12>>
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
<<var;match=1..12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": f"{_BSD} {_BSD_AS_IS}",
    "bsd-3-clause": f"""{_BSD} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;match=1..12>> nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>",
    "gpl": """free software<<beginOptional>>: you can redistribute it and/or modify it<<endOptional>> under the terms of the GNU
<<beginOptional>>Lesser<<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>""",
    "cc-by": "licensed under <<beginOptional>>a<<endOptional>> Creative Commons Attribution <<var;match=0..3>> <<beginOptional>>International<<endOptional>> License",
    "cc-by-short": "<<beginOptional>>licensed under<<endOptional>> CC BY <<beginOptional>>SA<<endOptional>> 4.0",
    "spdx": "SPDX License Identifier <<var;match=1..6>>",
}
LABEL = {"mit-short": "mit", "cc-by-short": "cc-by"}

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text: lower-cased runs of digits, a-z and characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Automaton:
    """A template as states with word edges, edges for any word, and free edges."""

    def __init__(self, template: str):
        self.word: list[dict[bytes, int]] = [{}]
        self.any: list[int] = [-1]
        self.free: list[list[int]] = [[]]
        self.longest, run, best, depth, opened, here = 0, [], [], 0, [], 0
        for part in re.split(r"(<<.*?>>)", template):
            if part == "<<beginOptional>>":
                opened.append(here)
                depth, best, run = depth + 1, max(best, run, key=lambda x: len(b" ".join(x))), []
            elif part == "<<endOptional>>":
                self.free[opened.pop()].append(here)
                depth -= 1
            elif m := re.fullmatch(r"<<var;match=(\d+)\.\.(\d+)>>", part):
                best, run = max(best, run, key=lambda x: len(b" ".join(x))), []
                low, high = int(m[1]), int(m[2])
                skips = []
                for k in range(high):
                    if k >= low:
                        skips.append(here)
                    here = self._new(any_from=here)
                for s in skips:
                    self.free[s].append(here)
                self.longest += high
            else:
                for w in words(part):
                    self.longest += 1
                    here = self._new(word_from=here, w=w)
                    if not depth:
                        run.append(w)
        best = max(best, run, key=lambda x: len(b" ".join(x)))
        self.end, self.anchor = here, b" " + b" ".join(best) + b" "

    def _new(self, any_from: int | None = None, word_from: int | None = None, w: bytes = b"") -> int:
        self.word.append({})
        self.any.append(-1)
        self.free.append([])
        to = len(self.word) - 1
        if any_from is not None:
            self.any[any_from] = to
        else:
            self.word[word_from][w] = to
        return to

    def _close(self, threads: dict[int, int]) -> dict[int, int]:
        todo = list(threads)
        while todo:
            s = todo.pop()
            for t in self.free[s]:
                if threads[s] < threads.get(t, 1 << 60):
                    threads[t] = threads[s]
                    todo.append(t)
        return threads

    def find(self, ws: list[bytes], low: int, high: int) -> list[tuple[int, int]]:
        """(first word, end) of accepted passages within ws[low:high]: of those that end together, the longest."""
        threads, out = {}, []
        for i in range(low, min(high, len(ws)) + 1):
            threads.setdefault(0, i)
            self._close(threads)
            if self.end in threads and threads[self.end] < i:
                out.append((threads[self.end], i))
            if i == len(ws):
                break
            w, step = ws[i], {}
            for s, first in threads.items():
                for t in (self.word[s].get(w, -1), self.any[s]):
                    if t >= 0 and first < step.get(t, 1 << 60):
                        step[t] = first
            threads = step
        return out


AUTOMATA = {name: Automaton(text) for name, text in TEMPLATES.items()}


def places(norm: bytes, phrase: bytes) -> list[int]:
    """Word positions at which phrase (words with a space on either side) stands in norm; one pass, whatever their number."""
    out, at, seen, n = [], norm.find(phrase), 0, 0
    while at >= 0:
        n, seen = n + norm.count(b" ", seen, at), at
        out.append(n)
        at = norm.find(phrase, at + 1)
    return out


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of a text."""
    ws = words(text)
    norm = b" " + b" ".join(ws) + b" "
    base, found, matches = [], set(), []
    for phrase, label in PHRASES.items():
        if at := places(norm, f" {phrase} ".encode()):
            base += at
            found.add(label)
    for name, a in AUTOMATA.items():
        if a.anchor in norm:
            spans: list[list[int]] = []  # what the anchors' surroundings cover together
            for p in places(norm, a.anchor):
                low, high = max(p - a.longest, 0), p + a.longest
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            matches += [(LABEL.get(name, name), *x) for low, high in spans for x in a.find(ws, low, high)]
    matches = sorted(set(matches))
    labels = found | {x[0] for x in matches}
    score = 1.0 if matches else min(0.9, 0.5 + 0.1 * len(base)) if base else 0.0
    return len(ws), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), score, ",".join(f"{k}:{a}:{b}" for k, a, b in matches)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        cols = list(zip(*map(scan, batch.column(1).to_pylist()), strict=True)) or [()] * 8
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases, labels of phrases and accepted templates, a score and the matches."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCHEMA)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

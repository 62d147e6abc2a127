"""Checks of a run's paths before anything is opened: no output may be an input, another output, or a numbered file of one.

Local paths are compared as files (symbolic and hard links too); paths with a scheme by name.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

from readloom.options import Options


def remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def resolved(path: str) -> Path:
    """Where a path leads: links are followed, dangling ones too; ValueError for a cycle, OSError if the folder does not exist."""
    p = Path(path.removeprefix("file://"))
    for _ in range(40):
        if p.exists():
            return p.resolve(strict=True)
        if not p.is_symlink():
            return p.parent.resolve(strict=True) / p.name
        p = p.parent / os.readlink(p)
    raise ValueError(f"too many links: {path}")


def same(a: Path, b: Path) -> bool:
    return a == b or (a.exists() and b.exists() and os.path.samefile(a, b))


def numbered_of(path: Path, base: Path, most: int | None) -> bool:
    """Whether path is a numbered file of base."""
    m = re.fullmatch(rf"([0-9]+)\.{re.escape(base.name)}", path.name)
    return bool(m) and path.parent == base.parent and 0 < int(m[1]) <= (most or int(m[1]))


def outputs(o: Options) -> dict[str, str]:
    """The run's outputs by route, reports with them."""
    named = {"out1": o.out1, "out2": o.out2, "merged": o.merged_out, "unpaired1": o.unpaired1, "unpaired2": o.unpaired2, "failed": o.failed_out, "overlapped": o.overlapped_out or None}
    named |= {"json": o.json if o.stats_format != "off" else None, "html": o.html}
    return {k: str(v) for k, v in named.items() if v and v != "-"}


def check(o: Options) -> None:
    """ValueError if the outputs of normalised options would destroy something."""
    inputs = [resolved(p) for p in (o.in1, o.in2) if p and p != "-" and not remote(p)]
    seen: dict[str, tuple[str, Path]] = {}
    names: dict[str, str] = {}
    for key, path in outputs(o).items():
        if remote(path):
            if path in names and {names[path], key} != {"unpaired1", "unpaired2"}:
                raise ValueError(f"outputs must be distinct: {path}")
            names[path] = key
            continue
        p = resolved(path)
        if p.is_dir():
            raise ValueError(f"an output is a folder: {path}")
        if any(same(i, p) for i in inputs):
            raise ValueError(f"an output would overwrite an input: {path}")
        for other, (_, q) in seen.items():
            if same(p, q) and {other, key} != {"unpaired1", "unpaired2"}:
                raise ValueError(f"outputs must be distinct: {path}")
        if o.dont_overwrite and os.path.lexists(path.removeprefix("file://")):
            raise ValueError(f"an output exists: {path}")
        seen[key] = (path, p)
    if not (o.split or o.split_by_lines):
        return
    bases = [Path(seen[k][0]).parent.resolve(strict=True) / Path(seen[k][0]).name for k in ("out1", "out2") if k in seen]
    for base in bases:
        is_own = lambda p: numbered_of(p, base, o.split)  # noqa: B023, E731
        if any(map(is_own, inputs)) or any(is_own(p) for _, p in seen.values()):
            raise ValueError(f"a numbered file of {base} would overwrite an input or another output")
        for entry in filter(is_own, base.parent.iterdir()):
            if o.dont_overwrite:
                raise ValueError(f"an output exists: {entry}")
            p = resolved(str(entry))
            if any(same(p, x) for x in [*inputs, *(q for _, q in seen.values())]) or (p != entry and any(numbered_of(p, b, o.split) for b in bases)):
                raise ValueError(f"a numbered file leads to an input or another output: {entry}")

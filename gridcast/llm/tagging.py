"""Tokens and word-shape features for the two span-tagging operators."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np

#: feature rows are hashed into this many buckets
BUCKETS = 1 << 12

_LETTERS_UP = re.compile(r"[^\W\d_a-z]+")
_DIGITS = re.compile(r"[0-9]+")


def shape(token: str) -> str:
    """Word shape: digits 9, lower a, upper A, other signs as they are; runs
    are written once with a length class (1, 2, 3, 4, 5-7, 8-15, 16+)."""
    out, last, run = [], "", 0
    for c in token:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if k == last:
            run += 1
            continue
        if last:
            out.append(last + _run(run))
        last, run = k, 1
    if last:
        out.append(last + _run(run))
    return "".join(out[:8])


def _run(n: int) -> str:
    return str(n) if n <= 4 else "5" if n <= 7 else "8" if n <= 15 else "16"


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % (BUCKETS - 1) + 1


def features(rows: list[list[str]], shared: list[list[str]] | None = None,
             memo: dict[str, int] | None = None) -> np.ndarray:
    """Hashed features of the tokens of one sequence: each token's own names
    with those of its neighbours up to two places away (kept apart by place),
    and the sequence's shared ones. Every token gives the same number."""
    memo = {} if memo is None else memo

    def at(name: str) -> int:
        if name not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[name] = bucket(name)
        return memo[name]

    n, out = len(rows), []
    for i, own in enumerate(rows):
        line = [at(x) for x in own]
        for d in (-2, -1, 1, 2):
            near = rows[i + d] if 0 <= i + d < n else ("edge", "edge")
            line.append(at(f"{d}|{near[0]}"))
            if d in (-1, 1):
                line.append(at(f"{d}|{near[1]}"))
        left = rows[i - 1][0] if i else "edge"
        right = rows[i + 1][0] if i + 1 < n else "edge"
        line += [at(f"l|{left}|{own[0]}"), at(f"r|{own[0]}|{right}"), at(f"w|{left}|{own[0]}|{right}")]
        line += [at(x) for x in shared or ()]
        out.append(line)
    return np.array(out, np.int64)


def runs(labels: np.ndarray, begin: dict[int, str], inside: dict[int, str]) -> list[tuple[str, int, int]]:
    """(kind, first token, last token) of begin/inside label runs."""
    out, open_ = [], None
    for i, k in enumerate(labels):
        k = int(k)
        if k in begin:
            if open_:
                out.append(open_)
            open_ = (begin[k], i, i)
        elif k in inside and open_ and open_[0] == inside[k]:
            open_ = (open_[0], open_[1], i)
        else:
            if open_:
                out.append(open_)
            open_ = None
    return out + ([open_] if open_ else [])


class Taken:
    """Stretches of a text that spans cover, joined; asks in logarithmic time."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for _, s, e in sorted(spans, key=lambda x: x[1]):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        """Does [start, end) share a place with a span?"""
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start

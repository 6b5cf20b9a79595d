"""Plain-Python versions of pipeline steps for comparison."""

import re
import zlib

import numpy as np
import public_tokenizers as P
import xxhash
from tokenizers import Tokenizer


def slow_simhash(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows: list[tuple[int, str]]) -> set[int]:
    """The smallest id of each group linked at two or fewer bits."""
    rows = sorted(rows)
    fps = [slow_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[find(i)][0] for i in range(len(rows))}


def packed_texts(rows: list[tuple[int, str]], capacity: int = 4096) -> list[tuple]:
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)

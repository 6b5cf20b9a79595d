"""Byte-level BPE by backtracking from longest matches.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the
vocabulary finds, in one pass over a piece, every token at every place. The
encoder takes the longest token at each place and steps back to a shorter one
when two neighbours are not compatible; a pair is compatible when merging
its bytes alone gives the same two tokens, and a sequence of pairwise
compatible tokens is exactly the one the merges give. Pair answers are kept,
and a place that failed once is never tried again, so a piece takes linear
time. Vocabulary entries that the merges cannot reach never stand inside a
longer piece; a piece that is an entry itself is that one token.

Defined results: a null or empty text has no ids; equal texts have equal
ids; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from gridcast.llm.texts import map_texts, per_worker

VOCABULARY = "byte_bpe_50k.tiktoken"
#: bounds on what a worker keeps: encoded pieces and answered pairs
MEMO_PIECES = 800_000
MEMO_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.never = max(ranks.values(), default=0) + 1
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or len(self.merge(token)) == 1:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def merge(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """The definition: merge the lowest-ranked neighbours, leftmost first,
        on request only those of a rank below a bound."""
        below = self.never if below is None else below
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            low = min((r for r in ranked if r >= 0), default=below)
            if low >= below:
                break
            i = ranked.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, rank: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that stand at one edge of a token (0 left, 1 right) while
        it is merged: (bytes, from, until) in ranks, the token itself last."""
        known = self.edges[side].get(rank)
        if known is None:
            whole = self.bytes_of[rank]
            if len(whole) == 1:
                known = [(whole, -1, self.never)]
            else:
                parts = self.merge(whole, rank)
                below = self.edge(self.ranks[parts[-side]], side)
                known = below[:-1] + [below[-1][:2] + (rank,), (whole, rank, self.never)]
            self.edges[side][rank] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before both tokens are
        whole: some part at the end of ``a`` and some part at the start of
        ``b`` stand at the same time and their merge has its turn then. Of
        merges of one rank the left one goes first."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = True
            rank_of = self.ranks.get
            left = self.edge(b, 0)
            for x, x_from, x_until in self.edge(a, 1):
                for y, y_from, y_until in left:
                    turn = rank_of(x + y)
                    if turn is not None and max(turn, x_from, y_from) < x_until \
                            and max(turn, x_from) <= y_until and y_from < y_until:
                        known = False
                        break
                if not known:
                    break
            self.pairs[a, b] = known
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            at[end + 1 - size].append((size, rank))
        # matches at a start come by their ends, so the longest is last
        tried = [len(x) for x in at] + [0]
        ids: list[int] = []
        starts: list[int] = []
        place = 0
        while place < n:
            options, step = at[place], None
            while tried[place]:
                tried[place] -= 1
                size, rank = options[tried[place]]
                end = place + size
                if (end == n or tried[end]) and (not ids or self.compatible(ids[-1], rank)):
                    step = (rank, end)
                    break
            if step is None:  # nothing fits here: the token before must be shorter
                place = starts.pop()
                ids.pop()
                continue
            ids.append(step[0])
            starts.append(place)
            place = step[1]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            got = self.pieces.get(piece)
            if got is None:
                if len(self.pieces) >= MEMO_PIECES:
                    self.pieces.clear()
                got = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    self.pieces[piece] = got
            out += got
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by one space),
    decoded_sha256 (of the decoded bytes) and, on request, the ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    def work(texts: list[str]) -> list[list]:
        bpe = per_worker(("byte bpe", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))
        ids = [bpe.encode(t) for t in texts]
        sha = [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids]
        back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
        return [[len(x) for x in ids], sha, back] + ([ids] if with_ids else [])

    return map_texts(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string"
                     + (", ids array<int>" if with_ids else ""), work)

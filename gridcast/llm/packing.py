"""Best-fit packing by a configuration linear program.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Only the histogram of piece lengths (at most ``capacity`` rows, whatever the
input) reaches the driver. There the configuration program (as few
sequences as cover every length's demand) is solved by multiplicative
weights: lengths lose weight as they are covered, in small steps, and a knapsack
dynamic program prices the configurations of largest weight, until every length
is covered; the prices also give a dual bound, and so the gap (``solve`` reports
both). The fractional solution is rounded down to whole configurations, some are
taken once more, and the few pieces left are packed best fit.

The plan says for each length which of its pieces (by number) go to which
sequences and places. Pieces are numbered per length in two levels, so no
length's pieces ever meet in one task, and looked up in the plan by (length,
block of numbers).

Defined results: a null or empty text is the one closing id; repeated rows
are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.texts import per_worker, slices
from gridcast.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
#: bound on the words that a worker keeps
MEMO_WORDS = 1_000_000
#: pieces that a numbering task gets, about
NUMBERED = 20_000
#: plan rows up to which the plan is broadcast (48 bytes each)
BROADCAST_ROWS = 400_000


#: a run of Latin letters, then ASCII signs but no apostrophe: two pre-tokens
#: at most, and the run's ids end with the only end-of-word id
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


#: letters of ASCII and Latin-1 (in UTF-8), digits, ASCII white space, . and ,
_SIMPLE = (bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + b" \t\n\x0b\x0c\r.,\xc3"
           + bytes(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)))
_DOUBLE = (b"..", b",,", b".,", b",.")


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space: a word's ids
    do not depend on its neighbours, so each word is encoded once, and the
    letters of a plain word once for all its signs and cases. Ids are
    little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the characters that stand for bytes: printable ones for themselves,
        # the others numbered from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [c for c in range(256) if c not in shown]
        self.place = {c: 256 + i for i, c in enumerate(hidden)}
        self.memo: dict[bytes, bytes] = {}

    def _keep(self, memo: dict[bytes, bytes], some: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, last = ids.tobytes(), 0
        for w, e in zip(some, (ends * 4).tolist()):
            memo[w] = raw[last:e]
            last = e

    def _learn_runs(self, runs: list[bytes]) -> None:
        """A run is one pre-token, so the merges alone give its ids."""
        merges, memo, place = self.tokenizer.model.tokenize, self.memo, self.place
        for r in runs:
            text = r.decode() if r.isascii() else r.decode().lower().encode().decode("latin-1").translate(place)
            memo[r] = array("I", [t.id for t in merges(text)]).tobytes()

    def _learn_words(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 2000):
            some = words[i:i + 2000]
            got = self.tokenizer.encode([w.decode("utf-8", "replace") for w in some],
                                        is_pretokenized=True, add_special_tokens=False)
            own = np.array(got.word_ids, np.int64)
            self._keep(self.memo, some, np.array(got.ids, "<u4"),
                       np.searchsorted(own, np.arange(len(some)), side="right"))

    def learn(self, words: list[bytes]) -> None:
        plain, other = [], []
        for w in words:
            m = _PLAIN.fullmatch(w)
            if m:
                plain.append((w, m[1].lower(), m[2]))
            else:
                other.append(w)
        memo = self.memo
        self._learn_words(other + [s for s in dict.fromkeys(s for _, _, s in plain) if s and s not in memo])
        self._learn_runs([r for r in dict.fromkeys(r for _, r, _ in plain) if r not in memo])
        memo.update((w, memo[r] + memo[s] if s else memo[r]) for w, r, s in plain if w != r)

    def words(self, text: str) -> list[bytes]:
        """The text in words whose ids follow one another. Case is dropped by
        the tokenizer, so it goes first (but for texts that could spell a
        special token). Full stops and commas are pre-tokens of their own where
        no sign stands beside them; in texts of letters, digits, stops and
        commas that can be seen at once, and they are split off."""
        raw = text.encode("utf-8", "replace")
        if b"<|" in raw:
            return raw.split()
        raw = raw.lower()
        if not raw.translate(None, _SIMPLE) and not any(p in raw for p in _DOUBLE):
            raw = raw.replace(b".", b" . ").replace(b",", b" , ")
        return raw.split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            words = self.words(text)
            try:
                yield b"".join(map(self.memo.__getitem__, words))
            except KeyError:
                if len(self.memo) > MEMO_WORDS:
                    self.memo.clear()
                self.learn([w for w in dict.fromkeys(words) if w not in self.memo])
                yield b"".join(map(self.memo.__getitem__, words))


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
               id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(("word ids", path), lambda: WordIds(path))
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(coder.encode(texts)):
                raw += end
                n = len(raw) // 4
                for k in range(0, n, capacity):
                    part = raw[4 * k:4 * (k + capacity)]
                    row.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                   pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            out += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(out, names)

    return picked.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
                             + (", ids array<int>" if with_ids else ""))


#: steps of the program, tried until its gap to the dual bound is at most GAP
STEPS, GAP = (1.0, 0.5, 0.25), 0.005
#: room that a configuration rounded up may leave free, as a share
ROUNDED_WASTE = 1 / 64
SALT = "_salt"


def price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each room, and the length put in
    last (0: leave one token free)."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = value
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = best[room - 1::-1] + worth[1:room + 1]
        k = int(gain.argmax())
        if gain[k] > best[room - 1]:
            best[room], last[room] = gain[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, last


def _taken(last: np.ndarray, room: int, first: int = 0) -> tuple[tuple[int, int], ...]:
    """The configuration behind a room, with a length put in before."""
    out: dict[int, int] = {first: 1} if first else {}
    room -= first
    while room > 0:
        k = int(last[room])
        if k:
            out[k] = out.get(k, 0) + 1
        room -= k or 1
    return tuple(sorted(out.items(), reverse=True))


def price_some(value: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The same knapsack for a few lengths: the best value of each room after
    each length in turn (rows), taking 1, 2, 4, ... more of it."""
    best = np.zeros((len(lengths) + 1, capacity + 1))
    for i, (k, v) in enumerate(zip(lengths.tolist(), value.tolist()), 1):
        now = best[i]
        now[:] = best[i - 1]
        while k <= capacity:
            np.maximum(now[k:], now[:capacity + 1 - k] + v, out=now[k:])
            k, v = 2 * k, 2 * v
    return best


def _taken_some(best: np.ndarray, lengths: list[int], room: int, first: int) -> tuple[tuple[int, int], ...]:
    out, i = {first: 1}, len(lengths)
    room -= first
    while room > 0 and i > 0:
        if best[i, room] == best[i - 1, room]:
            i -= 1
        else:
            k = lengths[i - 1]
            out[k] = out.get(k, 0) + 1
            room -= k
    return tuple(sorted(out.items(), reverse=True))


class Covering:
    """The covering program by multiplicative weights: how often to use each
    configuration so that the pieces of every length are covered once.

    A length's weight is its size times exp(-ETA * how far it is covered). Each
    round prices the lengths not yet covered by the knapsack, and for each of
    them takes the best configuration that holds it, in steps that cover at
    most the share ``step`` of any length. A round prices all open lengths, or,
    when such a round helped few of them, ``SOME`` drawn at random and what
    fills a sequence with them, for ``AGAIN`` rounds (many small lengths need
    many different fillings). It ends when every length is covered. ``bound``
    is the best of the dual bounds that the full pricings give (weights over
    the best configuration's value), so ``gap`` says how far the solution can
    be from the optimum."""

    ETA, SOME, AGAIN, FEW, SHARE = 1.0, 48, 40, 4, 200

    def __init__(self, hist: dict[int, int], capacity: int, step: float = 1.0, seed: int = 0):
        self.step = step
        self.lengths = np.array(sorted(hist), np.int64)
        self.demand = np.array([hist[k] for k in self.lengths.tolist()], float)
        self.at = {k: i for i, k in enumerate(self.lengths.tolist())}
        self.capacity, self.use, self.bound = capacity, {}, 0.0
        self.cover, self.draw = np.zeros(len(self.lengths)), np.random.default_rng(seed)
        wait = 0
        while (self.cover < 1 - 1e-9).any():
            if wait:
                wait -= 1
                self._round_some()
            elif self._round_all():
                wait = self.AGAIN
        self.total = sum(self.use.values())

    def gap(self, bound: float) -> float:
        return self.total / bound - 1 if bound else 0.0

    def _weights(self) -> np.ndarray:
        w = self.lengths / self.capacity * np.exp(-self.ETA * (self.cover - self.cover.min()))
        return np.where(self.cover < 1 - 1e-9, w, 0.0)

    def _round_all(self) -> bool:
        """True if it helped few lengths."""
        w, open_ = self._weights(), np.flatnonzero(self.cover < 1 - 1e-9)
        best, last = price(w[open_], self.lengths[open_], self.capacity)
        self.bound = max(self.bound, float((self.demand * w).sum() / best[self.capacity]))
        helped = self._steps(open_, lambda k: _taken(last, self.capacity, k))
        return helped < max(self.FEW, len(open_) // self.SHARE)

    def _round_some(self) -> None:
        open_ = np.flatnonzero(self.cover < 1 - 1e-9)
        if not len(open_):
            return
        if len(open_) > self.SOME:
            lack = (1 - self.cover[open_]) * self.demand[open_] * self.lengths[open_]
            chance = 0.5 * lack / lack.sum() + 0.5 / len(open_)
            some = self.draw.choice(open_, self.SOME, replace=False, p=chance).tolist()
            # what fills a sequence together with one of them
            rest = (self.at.get(self.capacity - int(self.lengths[i]), -1) for i in some)
            open_ = np.array(sorted({*some, *(j for j in rest if j >= 0 and self.cover[j] < 1 - 1e-9)}))
        own = self.lengths[open_]
        best = price_some(self._weights()[open_], own, self.capacity)
        names = own.tolist()
        self._steps(open_, lambda k: _taken_some(best, names, self.capacity, k))

    def _steps(self, open_: np.ndarray, config_of) -> int:
        grown, helped, misses = np.zeros(len(self.lengths)), 0, 0
        for i in open_[np.lexsort((-self.lengths[open_], self.cover[open_]))].tolist():
            room = min(self.step, 1 - self.cover[i]) - grown[i]
            if room <= 1e-9:
                continue
            config = config_of(int(self.lengths[i]))
            rows = [self.at[k] for k, _ in config]
            times = np.array([a for _, a in config], float)
            left = np.maximum(np.minimum(self.step, 1 - self.cover[rows]) - grown[rows], 0)
            step = float((left * self.demand[rows] / times).min())
            if step <= 1e-6:  # its filling is used up in this round
                misses += 1
                if helped:
                    if misses > 64 + 4 * helped:
                        break
                    continue
                step = float(room * self.demand[i] / times[rows.index(i)])
            helped += 1
            self.use[config] = self.use.get(config, 0.0) + step
            grown[rows] += step * times / self.demand[rows]
        self.cover += grown
        return helped


@dataclass
class Report:
    """What the program gave: its dual bound and gap, the sequences used and
    the share of them that are configurations of the program."""

    bound: float
    gap: float
    sequences: int
    by_program: float


def solve(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], Report]:
    """(configuration, how many sequences), covering the histogram exactly,
    and the report. The program's uses are rounded down; then its
    configurations are taken once more each, largest rest first, as long as
    all their pieces are left; the few pieces that remain are packed best fit."""
    left, out = dict(hist), []

    def place(config, most: float) -> None:
        n = min([int(most)] + [left.get(k, 0) // a for k, a in config])
        if n > 0:
            out.append((config, n))
            for k, a in config:
                left[k] -= a * n

    program, bound = None, 0.0
    for step in STEPS:  # smaller steps where the gap is not small enough
        tried = Covering(hist, capacity, step)
        bound = max(bound, tried.bound)
        program = tried if program is None or tried.total < program.total else program
        if program.gap(bound) <= GAP:
            break
    use = program.use
    for config, x in sorted(use.items(), key=lambda p: (-p[1], p[0])):
        place(config, math.floor(x + 1e-9))
    full = capacity * (1 - ROUNDED_WASTE)
    for config in sorted(use, key=lambda c: (math.floor(use[c] + 1e-9) - use[c], c)):
        if sum(k * a for k, a in config) >= full:
            place(config, 1)
    for config in sorted(use):
        if sum(k * a for k, a in config) == capacity:
            place(config, 2 ** 62)
    own = sum(n for _, n in out)
    open_ = sorted(k for k, n in left.items() if n)
    while open_:
        room, config, upto = capacity, [], len(open_)
        while room > 0:
            i = bisect.bisect_right(open_, room, 0, upto) - 1
            if i < 0:
                break
            k = open_[i]
            a = min(room // k, left[k])
            config.append((k, a))
            room -= a * k
            upto = i
        place(tuple(config), 2 ** 62)
        for k, _ in config:
            if not left[k]:
                open_.pop(bisect.bisect_left(open_, k))
    total = sum(n for _, n in out)
    return out, Report(bound, program.gap(bound), total, own / total if total else 1.0)


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    return solve(hist, capacity)[0]


def plan_rows(configs: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, times, first sequence, offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for config, n in configs:
        offset = 0
        for k, a in config:
            lo = used.get(k, 0)
            used[k] = lo + a * n
            rows.append((k, lo, lo + a * n, a, sequence, offset))
            offset += a * k
        sequence += n
    return rows


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    spark = pieces.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in
            pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan_rows(plan(hist, capacity))
    total = sum(hist.values())
    buckets = max(1, total // NUMBERED)
    names = [c for c in pieces.columns if c != SALT]
    # the numbers of a length are cut into as many blocks as it has plan rows,
    # so a piece meets the one or two plan rows of its block, not all of its length
    held = Counter(r[0] for r in rows)
    width = {k: -(-hist[k] // n) for k, n in held.items()}
    widths = spark.createDataFrame(pa.table({"_of": pa.array(list(width), pa.int64()),
                                             "_width": pa.array(list(width.values()), pa.int64())}))  # at most capacity rows
    spread = [(*r, b) for r in rows for b in range(r[1] // width[r[0]], (r[2] - 1) // width[r[0]] + 1)]
    table = spark.createDataFrame(
        pa.table({n: pa.array([r[i] for r in spread], pa.int64())
                  for i, n in enumerate(("_length", "_lo", "_hi", "_times", "_sequence", "_offset", "_place"))}))
    if len(spread) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    dealt = pieces.withColumn("_bucket", F.pmod(F.col(SALT), F.lit(buckets)))
    before = (dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("length", "_bucket", F.coalesce(F.sum("_n").over(
                  Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)).alias("_before")))
    numbered = (dealt.withColumn("_rank", F.row_number().over(
                    Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
                .join(before, ["length", "_bucket"])
                .withColumn("_number", F.col("_rank") + F.col("_before")))
    slot = F.col("_number") - F.col("_lo")
    near = (numbered.join(F.broadcast(widths), F.col("length") == F.col("_of"))
            .withColumn("_block", F.floor(F.col("_number") / F.col("_width")).cast("long")))
    return (near.join(table, (F.col("length") == F.col("_length")) & (F.col("_block") == F.col("_place"))
                      & (F.col("_number") >= F.col("_lo")) & (F.col("_number") < F.col("_hi")))
            .withColumn("sequence_id", F.col("_sequence") + F.floor(slot / F.col("_times")).cast("long"))
            .withColumn("offset", F.col("_offset") + F.pmod(slot, F.col("_times")) * F.col("length"))
            .select(*names, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids),
    sequence_id, offset. The pieces are written once to the shared scratch
    folder, as the histogram and the placing both read them."""
    spark = docs.sparkSession
    at = scratch_path(spark, "pieces")
    # the salt is written, so that both readers see the same; ids may be null or repeat
    pieces = cut_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids)
    pieces.withColumn(SALT, F.shiftright(F.xxhash64(F.rand(11)), 1)).write.parquet(at)
    return place_pieces(spark.read.parquet(at), capacity)

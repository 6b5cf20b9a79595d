"""Language-model scoring by online logistic context mixing.

A text is its words (A-Z in lower case, split at ASCII blanks) and one end.
Every word is coded as bits, and every bit is predicted by several predictors,
each a table of counts under a hashed context; the predictions (as logits)
are combined by weights that a gate chooses by the bit's depth in the code and by
how often its contexts were seen, and refined by an adaptive map of the result.
Weights and map start from fitted values and go on learning online in each
text, in blocks that double from 32 to 1,024 words (all bits of a block are
predicted with the weights the blocks before it left), so that many texts
advance together in numpy. A text's bits add up to its log10 probability and
its bits per byte.

* **Code.** The most frequent training words (``WORDS``, one broadcast list of a
  bounded size), the end and an escape have a Huffman code over the training
  counts; contexts of its bits are the node, and the node with the one and the two
  words before it. Any other word is the escape and a flag: seen twice or more,
  it is coded by its share of such words' counts; else by its spelling: bytes and
  a closing blank, bit by bit under the one to four bytes before, computed once
  per distinct word, not per occurrence.
* **What is learnt.** Word counts, the counts of all contexts, the spelling
  counts and the start of the weights come from all training texts (each
  distinct word is one example of spelling). The weights are fitted to every bit with
  that bit itself taken out of the counts, as the tables have not seen a new
  text's bits: every task sweeps its texts once by Newton steps, and the tasks'
  weights are averaged by their information (second derivatives).
* **Passes.** Texts are split into words twice: once to count the words, once to
  write every text as its symbols (two bytes each) and its words without a code.
  The passes that count contexts, fit the weights and score read that table.
* **Scale.** Frequent words never meet a shuffle: their counts are broadcast
  and summed in the row. Only the others travel, as (text, word, n), to the word
  table, by word; each is rare by the list's making. Context tables have a
  fixed number of slots; tasks emit them in blocks of 65,536 slots, added up
  in two rounds by (block, part of the tasks) and by block.

A null text is the empty text (one token, the end). A null id is never held out.
Words of any length count whole; those over 48 bytes go by a 128-bit digest.
Equal texts get equal scores; repeated rows stay rows. Without any training text
every count is 0 and all words are spelt. Empty table: no rows. Other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.texts import per_worker, slices
from gridcast.session import forget, written

#: words with a code of their own
WORDS = 65_534
#: training counts that a word with a code has at least: the words seen less
#: often stand for those never seen, so the escape is counted as often as they are
LEAST = 2
#: slots of each hashed context table, as a power of two
SLOT_BITS = 20
#: words longer than this go by digest
LONG = 48
END, ESCAPE = 0, 1
#: words of a block: the first, and the most
FIRST_BLOCK, LAST_BLOCK = 32, 1024
#: words of all texts that advance together
WAVE = 4_096
#: bytes that are spelt together
SPELT = 1 << 16
#: bytes of symbols that a worker takes at once, about
SLICE_IDS = 1 << 20
#: distinct words that a task holds before it gives them out
HELD_WORDS = 200_000
#: slots of an emitted block of counts
BLOCK = 1 << 16
#: parts of the tasks whose blocks are added up first
PARTS = 64
#: prior count of either bit
PRIOR = 0.4
GATES, BINS = 24, 32
#: step of the weights and the map
RATE, MAP_RATE = 0.02, 0.02
#: how firmly the fit holds to equal weights
FIRM = 50.0
_ONE = np.zeros(1, np.int64)
_NODE, _SPREAD = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SPELL_BITS = (16, 18, 20, 20)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """Bytes have ASCII case and ASCII blanks only, as the tokens ask."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def key_of(word: bytes) -> bytes:
    return word if len(word) <= LONG else b" " + xxhash.xxh3_128_digest(word)


# ---- the code ---------------------------------------------------------------

class Code:
    """Huffman code of symbols 0 (end), 1 (escape), 2... (words)."""

    def __init__(self, weights: list[int]):
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        size, parent, sides = len(weights), {}, []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]], parent[b[1]] = (size, 0), (size, 1)
            sides.append((a[0], b[0]))
            heapq.heappush(heap, (a[0] + b[0], size))
            size += 1
        root, first = size - 1, len(weights)
        paths: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for i in range(size - 2, -1, -1):  # parents before children
            up, bit = parent[i]
            paths[i] = paths[up] + [(root - up, bit)]  # the root is node 0
        own = paths[:first]
        self.nodes = size - first
        #: training count of either bit at each node: the weights below
        self.sides = np.array(sides[::-1], np.int64)
        self.length = np.array([len(p) for p in own], np.int64)
        self.start = np.cumsum(self.length) - self.length
        flat = np.array([x for p in own for x in p], np.int32).reshape(-1, 2)
        depth = np.concatenate([np.arange(n) for n in self.length])
        #: node, depth class and bit of every entry of the paths, in one number
        #: so that a bit costs one look-up
        self.paths = (flat[:, 0] << 3 | np.minimum(depth // 4, 3) << 1 | flat[:, 1]).astype(np.uint32)

    @classmethod
    def built(cls, arrays: dict) -> Code:
        """The code with the attributes of one built before."""
        code = cls.__new__(cls)
        vars(code).update(arrays)
        return code

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every symbol, and the entry of the paths of every bit."""
        n = self.length[symbols]
        return n, np.take(self.paths, _ranges(self.start[symbols], n), mode="clip")

    @staticmethod
    def bit(paths: np.ndarray) -> np.ndarray:
        return (paths & np.uint32(1)).astype(np.float32)

    @staticmethod
    def deep(paths: np.ndarray) -> np.ndarray:
        return (paths >> np.uint32(1) & np.uint32(3)).astype(np.int32) * 6


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 2166136261, np.uint32)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def _slots(context: np.ndarray, mixed: np.ndarray, bits: int) -> np.ndarray:
    """Slots of bits; ``context`` is overwritten, ``mixed`` is node * _NODE."""
    context ^= mixed
    context *= _SPREAD
    context >>= np.uint32(32 - bits)
    return context


class WordContexts:
    """Slots of the three predictors of a word's bits in one table: the node,
    and the node under the word before and the two words before."""

    def __init__(self, code: Code, slot_bits: int):
        self.code, self.slot_bits = code, slot_bits
        room = -(-code.nodes // BLOCK) * BLOCK
        self.at = [0] + [room + i * max(1 << slot_bits, BLOCK) for i in range(2)]
        self.size = self.at[-1] + max(1 << slot_bits, BLOCK)

    def prepared(self, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Context hashes of every token; before a text's start comes the end."""
        one, two = np.zeros_like(ids), np.zeros_like(ids)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[starts] = END
        two[starts] = END
        later = starts + 1
        two[later[later < len(ids)]] = END
        return [_hash(one), _hash(one, two)]

    def slots(self, hashes: list[np.ndarray], tokens: np.ndarray | slice, n: np.ndarray, paths: np.ndarray) -> np.ndarray:
        node = paths >> np.uint32(3)
        out = np.empty((3, len(node)), np.int64)
        out[0] = node
        node *= _NODE
        for i, h in enumerate(hashes):
            np.add(_slots(np.repeat(h[tokens], n), node, self.slot_bits), self.at[i + 1], out=out[i + 1])
        return out

    def with_nodes(self, counts: np.ndarray) -> np.ndarray:
        """``counts`` (16 bits) with those of the first predictor, which the
        code itself knows."""
        counts[:self.code.nodes] = _short(self.code.sides)
        return counts


class SpellContexts:
    """Slots of the four predictors of a byte's bits: under the last one, two,
    three and four bytes of the word."""

    def __init__(self) -> None:
        self.at = [sum(1 << b for b in _SPELL_BITS[:i]) for i in range(4)]
        self.size = sum(1 << b for b in _SPELL_BITS)

    def grams(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, gram) of every byte of words spelt with a closing blank: the
        byte and the four before, the nearest one lowest; a gram does not reach
        before its word."""
        joined = b" ".join([*words, b""])
        text = np.frombuffer(joined, np.uint8).astype(np.int64)
        sizes = np.array([len(w) + 1 for w in words])
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        behind = np.arange(len(text)) - first[word]
        gram = text.copy()
        for k in (1, 2, 3, 4):
            out = np.full(len(text), 32, np.int64)
            out[k:] = text[:-k] if len(text) > k else out[k:]
            gram |= np.where(behind >= k, out, 32) << (8 * k)
        return word, gram

    def bits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots, bit, gate depth) of the eight bits of every gram's byte."""
        text, b1, b2, b3, b4 = ((grams >> (8 * k) & 255).astype(np.uint32) for k in range(5))
        contexts = [b1, _hash(b1, b2), _hash(b1, b2, b3), _hash(b1, b2, b3, b4)]
        steps = np.arange(7, -1, -1, dtype=np.uint32)
        whole = text | np.uint32(256)
        node = (whole[:, None] >> (steps + 1)[None, :]).ravel()
        bit = ((text[:, None] >> steps[None, :]) & 1).ravel().astype(np.float32)
        slots = np.empty((4, len(node)), np.int64)
        slots[0] = np.repeat(contexts[0], 8) * 256 + node
        mixed = node * _NODE
        for i in (1, 2, 3):
            slots[i] = _slots(np.repeat(contexts[i], 8), mixed, _SPELL_BITS[i])
            slots[i] += self.at[i]
        return slots, bit, np.tile(np.array([0, 0, 0, 1, 1, 2, 2, 3], np.int32) * 6, len(text))


# ---- tables -----------------------------------------------------------------

class Tables:
    """Predictors' logits from counts (slots, 2). The two lowest bits of a
    logit say how often its slot was seen (0: once at most, 1: up to twelve
    times, 2: more), so that one look-up gives both."""

    def __init__(self, counts: np.ndarray):
        self.logit = self._logits(counts.astype(np.float32))

    @staticmethod
    def _logits(n: np.ndarray) -> np.ndarray:
        seen = n.sum(axis=1)
        logit = np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR)).astype(np.float32)
        often = (seen > 1).astype(np.int32) + (seen > 12)
        return (logit.view(np.int32) & ~3 | often).view(np.float32)

    def inputs(self, slots: np.ndarray) -> np.ndarray:
        return np.take(self.logit, slots, mode="clip")

    def gate(self, x: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """Depth class, and how well the second and third predictor are known."""
        often = x[1:3].view(np.int32) & 3
        return deep + often[0] * 2 + (often[1] > 0)


class TablesWithout(Tables):
    """Logits for bits that are in the counts themselves: without that bit."""

    def __init__(self, counts: np.ndarray):
        n = counts.astype(np.float32)
        self.logit = np.stack([self._logits(np.maximum(n - np.eye(2, dtype=np.float32)[b], 0)) for b in (0, 1)], axis=1).ravel()

    def inputs(self, slots: np.ndarray, bit: np.ndarray) -> np.ndarray:
        at = slots * 2
        at += bit.astype(np.int64)
        return np.take(self.logit, at, mode="clip")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))  # |x| stays under 50, see Mixer


def start_weights(k: int) -> np.ndarray:
    return np.full((GATES, k), 1.0 / k, np.float32)


class Mixer:
    """Gated weights and the adaptive map of several texts side by side."""

    def __init__(self, weights: np.ndarray, texts: int):
        self.weights = [np.tile(w.astype(np.float32), (texts, 1)) for w in weights.T]  # one (texts, gates) per predictor
        self.map = np.zeros((texts, BINS), np.float32)

    def step(self, texts: np.ndarray, of: np.ndarray, gate: np.ndarray, x: np.ndarray, bit: np.ndarray,
             learn: bool = True) -> np.ndarray:
        """ln probability of every bit; then the weights and the map of
        ``texts`` learn from the whole block. ``of`` says which of them a bit
        belongs to; ``x`` is (predictors, bits)."""
        at, size = of * GATES, len(texts) * GATES
        at += gate
        mixed, some = np.zeros(len(bit), np.float32), np.empty(len(bit), np.float32)
        for w, xj in zip(self.weights, x):
            np.take(w[texts], at, out=some, mode="clip")
            some *= xj
            mixed += some
        np.clip(mixed, -14.0, 14.0, out=mixed)
        np.add(mixed, 8.0, out=some)
        some *= 2.0
        cell = np.clip(some, 0, BINS - 1, out=some).astype(np.int64)
        cell += of * BINS
        mixed += np.take(self.map[texts], cell, out=some, mode="clip")  # map entries stay small: each step is damped
        sign = bit * 2 - 1
        mixed *= sign
        right = sigmoid(mixed)
        if learn:
            wrong = np.subtract(1.0, right, out=mixed)
            sign *= wrong
            error, slack = sign, np.multiply(wrong, right, out=wrong)
            square = x[0] * x[0]
            for xj in x[1:]:
                square += np.multiply(xj, xj, out=some)
            square *= slack
            damp = 1.0 + RATE * np.bincount(at, square, size)
            for w, xj in zip(self.weights, x):
                pull = np.bincount(at, np.multiply(error, xj, out=some), size)
                w[texts] += (RATE * pull / damp).reshape(-1, GATES).astype(np.float32)
            push = MAP_RATE * np.bincount(cell, error, len(texts) * BINS)
            push /= 1.0 + MAP_RATE * np.bincount(cell, slack, len(texts) * BINS)
            self.map[texts] += push.reshape(-1, BINS).astype(np.float32)
        return np.log(right, out=right)


class Fit:
    """Gated weights fitted in one sweep: every block of bits is a Newton step
    with the second derivatives of all blocks so far."""

    def __init__(self, k: int):
        self.weights = start_weights(k).astype(np.float64)
        self.firm = np.tile(np.eye(k) * FIRM, (GATES, 1, 1))
        self.second = self.firm.copy()

    def step(self, gate: np.ndarray, x: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        """Learn from bits, each ``times`` often; ``x`` is (predictors, bits)."""
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(gate, minlength=GATES))
        given, x = x, np.empty(x.shape, np.float32)
        for xj, out in zip(given, x):
            np.take(xj, order, out=out, mode="clip")
        bit = np.take(bit, order, mode="clip")
        times = None if times is None else np.take(times, order).astype(np.float32)
        weights, pull = self.weights.astype(np.float32), np.zeros((*self.weights.shape, 1))
        for g, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if a == b:
                continue
            some = x[:, a:b]
            p = sigmoid(np.clip(weights[g] @ some, -14.0, 14.0))
            error, slack = bit[a:b] - p, p * (1.0 - p)
            if times is not None:
                error, slack = error * times[a:b], slack * times[a:b]
            self.second[g] += (some * slack) @ some.T
            pull[g, :, 0] = some @ error
        self.weights += np.linalg.solve(self.second, pull)[:, :, 0]

    def sums(self) -> np.ndarray:
        """What adds up over tasks: second derivatives, and with the weights."""
        pull = np.einsum("gij,gj->gi", self.second, self.weights) - FIRM * start_weights(len(self.weights[0]))
        return np.concatenate([(self.second - self.firm).ravel(), pull.ravel()])

    @staticmethod
    def joined(sums: np.ndarray, k: int) -> np.ndarray:
        """The weights of all tasks' sums."""
        second = sums[:GATES * k * k].reshape(GATES, k, k) + np.eye(k) * FIRM
        pull = sums[GATES * k * k:].reshape(GATES, k) + FIRM * start_weights(k)
        return np.linalg.solve(second, pull[:, :, None])[:, :, 0].astype(np.float32)


def blocks(longest: int) -> Iterator[tuple[int, int]]:
    """(first token, tokens) of the blocks of a text."""
    at, size = 0, FIRST_BLOCK
    while at < longest:
        yield at, size
        at, size = at + size, min(2 * size, LAST_BLOCK)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ahead = np.repeat(first - (np.cumsum(size) - size), size)
    return np.arange(int(size.sum())) + ahead


def score_ids(texts: list[np.ndarray], tables: Tables, contexts: WordContexts, weights: np.ndarray) -> np.ndarray:
    """ln probability of each text's symbols, learning online within it."""
    n = np.array([len(t) for t in texts])
    ids, starts, out = np.concatenate(texts), np.cumsum(n) - n, np.zeros(len(texts))
    hashes, mixer = contexts.prepared(ids, starts), Mixer(weights, len(texts))
    code = contexts.code
    for first, size in blocks(int(n.max())):
        live = np.flatnonzero(n > first)
        take = np.minimum(n[live] - first, size)
        part = np.cumsum(take) // WAVE  # so many texts at once
        for some in np.split(np.arange(len(live)), np.flatnonzero(np.diff(part)) + 1):
            tokens = _ranges(starts[live[some]] + first, take[some])
            per_token, paths = code.bits(ids[tokens])
            ends = np.cumsum(per_token)[np.cumsum(take[some]) - 1]
            per_text = np.diff(ends, prepend=0)
            of = np.repeat(np.arange(len(some)), per_text)
            x = tables.inputs(contexts.slots(hashes, tokens, per_token, paths))
            got = mixer.step(live[some], of, tables.gate(x, code.deep(paths)), x, code.bit(paths))
            out[live[some]] += np.add.reduceat(got, ends - per_text, dtype=np.float64)
    return out


def _runs(texts: list[np.ndarray], contexts: WordContexts, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, paths) of the bits of ``size`` words at a time."""
    ids, n = np.concatenate(texts), np.array([len(t) for t in texts])
    hashes = contexts.prepared(ids, np.cumsum(n) - n)
    for a in range(0, len(ids), size):
        tokens = slice(a, a + size)
        n, paths = contexts.code.bits(ids[tokens])
        yield contexts.slots(hashes, tokens, n, paths), paths


def count_contexts(texts: list[np.ndarray], contexts: WordContexts, table: np.ndarray) -> None:
    """Add the bits of texts to ``table`` (slots, 2), but for the nodes' own
    counts, which are known."""
    flat = table.reshape(-1)
    for slots, paths in _runs(texts, contexts, WAVE * 4):
        side = paths & np.uint32(1)
        for slot in slots[1:]:
            slot *= 2
            slot += side
            np.add.at(flat, slot, 1)


def fit_contexts(texts: list[np.ndarray], tables: TablesWithout, contexts: WordContexts, fit: Fit) -> None:
    """Fit the weights to every bit of texts."""
    for slots, paths in _runs(texts, contexts, WAVE):
        bit = contexts.code.bit(paths)
        x = tables.inputs(slots, bit)
        fit.step(tables.gate(x, contexts.code.deep(paths)), x, bit)


def spell(words: list[bytes], tables: Tables, contexts: SpellContexts, weights: np.ndarray) -> np.ndarray:
    """ln probability of the spelling of each word."""
    out, at = np.zeros(len(words)), 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (size == 0 or size + len(words[end]) < SPELT):
            size += len(words[end]) + 1
            end += 1
        word, gram = contexts.grams(words[at:end])
        grams, which = np.unique(gram, return_inverse=True)
        slots, bit, deep = contexts.bits(grams)
        x = tables.inputs(slots)
        got = Mixer(weights, 1).step(_ONE, np.zeros(len(bit), np.int64), tables.gate(x, deep), x, bit, learn=False)
        out[at:end] = np.bincount(word, got.reshape(-1, 8).sum(axis=1, dtype=np.float64)[which], end - at)
        at = end
    return out


# ---- passes over the corpus -------------------------------------------------

def count_words(rows: DataFrame) -> DataFrame:
    """(key, n, long): training count of every word of the corpus, 0 if only
    held-out texts have it; the end is the empty key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        seen: set[bytes] = set()

        def given() -> pa.RecordBatch:
            more = [w for w in seen if w not in held]
            keys = [key_of(w) for w in held] + [key_of(w) for w in more]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([*held.values(), *([0] * len(more))], pa.int64())], ["key", "n"])

        for batch in slices(batches, 1):
            for text, out in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text or "")
                if out:
                    seen.update(words)
                else:
                    held.update(words)
                    held[b""] += 1
            if len(held) + len(seen) > HELD_WORDS:
                yield given()
                held.clear()
                seen.clear()
        yield given()

    return rows.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _short(n: np.ndarray) -> np.ndarray:
    """Counts in 16 bits; larger pairs are scaled down together."""
    high = np.maximum(n.max(axis=1, keepdims=True), 1)
    return np.where(high > 65535, np.maximum(n * (65535 / high), n > 0), n).astype(np.uint16)


def _counted(frame: DataFrame, size: int, work: Callable) -> np.ndarray:
    """Counts (slots, 2) summed over all rows: ``work`` adds a batch to a
    task's table. Saturated to 16 bits with the ratio kept."""
    pieces = -(-size // BLOCK)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        table, added = np.zeros((pieces * BLOCK, 2), np.int64), 0
        for batch in batches:
            work(batch, table)
        for i in range(pieces):
            piece = table[i * BLOCK:(i + 1) * BLOCK]
            if piece.any():
                kind = np.int32 if piece.max() < 1 << 31 else np.int64
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([piece.astype(kind).tobytes()], pa.binary())],
                    ["block", "part", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                kind = np.int32 if len(data) == BLOCK * 8 else np.int64
                sums[i] = sums.get(i, 0) + np.frombuffer(data, kind).astype(np.int64)
        for i, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int32()),
                                              pa.array([total.astype(np.int64).tobytes()], pa.binary())],
                                             ["block", "part", "counts"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in added(batches):
            n = np.frombuffer(batch.column(2)[0].as_py(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_short(n).tobytes()], pa.binary())],
                                             ["block", "part", "counts"])

    schema = "block int, part int, counts binary"
    first = frame.mapInArrow(tables, schema).repartition("block", "part").mapInArrow(added, schema)
    rows = first.repartition("block").mapInArrow(packed, schema).collect()  # as many rows as blocks of the tables
    out = np.zeros((pieces * BLOCK, 2), np.uint16)
    for r in rows:
        out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint16).reshape(-1, 2)
    return out


def _fitted(frame: DataFrame, k: int, work: Callable) -> np.ndarray:
    """Start weights: one sweep per task over all its rows, joined by what
    each has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = Fit(k)
        for batch in batches:
            work(batch, fit)
        sums = fit.sums()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["place", "v"])

    rows = frame.mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(GATES * k * (k + 1))
    for r in rows:
        sums[r["place"]] = r["v"]
    return Fit.joined(sums, k)


class Model:
    """What a worker needs, built once per process from the broadcast parts."""

    def __init__(self, parts: dict, tables: type[Tables] = Tables):
        self.code = Code.built(parts["code"]) if "code" in parts else Code(parts["weights"])
        self.index = {w: i + 2 for i, w in enumerate(parts["words"])}
        self.log10 = np.array(parts["log10"])
        self.known = np.array(parts["known"])
        self.words = WordContexts(self.code, parts["slot_bits"])
        self.spelling = SpellContexts()
        self.tables = tables(parts["counts"]) if "counts" in parts else None
        self.letters = tables(parts["letters"]) if "letters" in parts else None
        self.mix, self.spell_mix = parts.get("mix"), parts.get("spell_mix")

    def ids(self, words: list[bytes]) -> np.ndarray:
        out = np.full(len(words) + 1, END, np.int32)
        out[:-1] = np.fromiter(map(self.index.get, words, repeat(ESCAPE)), np.int32, len(words))
        return out


def _on_worker(shared, tables: type[Tables] = Tables) -> Callable[[], Model]:
    """The model of one broadcast, kept by a worker process from task to task
    until it meets another broadcast: a worker holds one model at a time."""
    name = uuid.uuid4().hex

    def model() -> Model:
        kept = per_worker(("context_mixing",), dict)
        if name not in kept:
            kept.clear()
            kept[name] = Model(shared.value, tables)
        return kept[name]

    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS,
                    slot_bits: int = SLOT_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes and bits_per_byte (null for an empty text) of every text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    vocabulary, words_at = written(count_words(rows), "words")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v"),
                           F.count(F.lit(1)).alias("rows")).first()
    size, room = total["n"], total["n"] + 0.5 * (total["v"] + 1)
    listed = (vocabulary.where((F.length("key") > 0) & (F.length("key") <= LONG) & (F.col("n") >= LEAST)
                               & (F.substring("key", 1, 1) != F.lit(b" ")))
              .orderBy(F.desc("n"), "key").limit(n_words).collect())  # a bounded list
    ends = vocabulary.where(F.length("key") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    counts = [r["n"] for r in listed]

    def log10(n: float) -> float:
        return math.log10((n + 0.5) / room)

    parts = {"words": [bytes(r["key"]) for r in listed], "slot_bits": slot_bits,
             "weights": [ends + 1, size - ends - sum(counts) + 1, *counts],
             "log10": [log10(ends), 0.0, *map(log10, counts)], "known": [int(ends > 0), 0, *([1] * len(counts))]}
    contexts = WordContexts(Code(parts["weights"]), slot_bits)
    parts["code"] = vars(contexts.code)
    code_only = spark.sparkContext.broadcast(parts)
    on_worker = _on_worker(code_only)
    kind = np.uint16 if len(listed) + 2 <= 1 << 16 else np.int32

    def symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, kind).astype(np.int32) for x in batch.column(2).to_pylist()]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            model = on_worker()
            n_bytes, ids, far, times = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = text or ""
                words = words_of(data)
                of_text = model.ids(words)
                rare = Counter([words[j] for j in np.flatnonzero(of_text == ESCAPE).tolist()])
                n_bytes.append(len(data) if data.isascii() else len(data.encode("utf-8", "surrogatepass")))
                ids.append(of_text.astype(kind).tobytes())
                far.append(b" ".join(rare))
                times.append(np.array([*rare.values()], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(far, pa.binary()),
                 pa.array(times, pa.binary()), pa.array(n_bytes, pa.int64())],
                ["doc_id", "held_out", "ids", "far", "times", "n_bytes"])

    # every later pass reads the texts as symbols and their words without one
    texts, coded_at = written(
        rows.mapInArrow(coded, f"doc_id {id_type}, held_out boolean, ids binary, far binary, times binary, n_bytes long"), "coded")
    code_only.destroy()
    training = texts.where(~F.col("held_out")).select("doc_id", "held_out", "ids")
    code_only = spark.sparkContext.broadcast({**parts, "words": []})
    on_worker1 = _on_worker(code_only)

    def context_counts(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for piece in slices(iter([batch]), 2, SLICE_IDS):
            count_contexts(symbols(piece), on_worker1().words, table)

    counts = _counted(training, contexts.size, context_counts)
    parts = {**parts, "words": [], "counts": contexts.with_nodes(counts)}
    code_only.destroy()

    def letter_counts(batch: pa.RecordBatch, table: np.ndarray) -> None:
        flat, spelling = table.reshape(-1), SpellContexts()
        grams, times = np.unique(spelling.grams(batch.column(0).to_pylist())[1], return_counts=True)
        for a in range(0, len(grams), WAVE):
            slots, bit, _ = spelling.bits(grams[a:a + WAVE])
            n = np.repeat(times[a:a + WAVE], 8)
            for slot in slots:
                np.add.at(flat, slot * 2 + bit.astype(np.int64), n)

    short = (F.length("key") > 0) & (F.substring("key", 1, 1) != F.lit(b" "))
    names = spark.createDataFrame([(r["key"],) for r in listed], "key binary") if listed else None
    rare = vocabulary.join(F.broadcast(names), "key", "left_anti") if names is not None else vocabulary
    rare, rare_at = written(rare.where(F.length("key") > 0), "rare")
    learnt = vocabulary.where(short & (F.col("n") > 0)).select("key", "n")
    often = rare.agg(F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("n"),
                     F.count_if(F.col("n") == 1).alias("once")).first()
    new = (often["once"] + 1) / (often["n"] + often["once"] + 2)  # of the words after an escape, spelt
    parts["letters"] = _counted(learnt, SpellContexts().size, letter_counts)
    tables_only = spark.sparkContext.broadcast(parts)
    on_worker2 = _on_worker(tables_only, TablesWithout)

    def fit_words(batch: pa.RecordBatch, fit: Fit) -> None:
        model = on_worker2()
        for piece in slices(iter([batch]), 2, SLICE_IDS):
            fit_contexts(symbols(piece), model.tables, model.words, fit)

    def fit_letters(batch: pa.RecordBatch, fit: Fit) -> None:
        model = on_worker2()
        grams, times = np.unique(model.spelling.grams(batch.column(0).to_pylist())[1], return_counts=True)
        for a in range(0, len(grams), WAVE):
            slots, bit, deep = model.spelling.bits(grams[a:a + WAVE])
            x = model.letters.inputs(slots, bit)
            fit.step(model.letters.gate(x, deep), x, bit, np.repeat(times[a:a + WAVE], 8))

    parts["mix"] = _fitted(training, 3, fit_words)
    parts["spell_mix"] = _fitted(learnt, 4, fit_letters)
    forget(spark, words_at)
    tables_only.destroy()
    whole = spark.sparkContext.broadcast(parts)
    on_worker3 = _on_worker(whole)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = on_worker3()
            got = np.full(batch.num_rows, np.nan)
            own = [(i, k) for i, (k, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                   if n < 2 and k[:1] != b" "]  # a digest is spelt where its word is
            if own:
                got[[i for i, _ in own]] = spell([k for _, k in own], model.letters, model.spelling, model.spell_mix)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, from_pandas=True)],
                                             ["key", "c", "ln"])

    spellings, _ = written(rare.select("key", F.col("n").alias("c")).mapInArrow(spelt, "key binary, c long, ln double"),
                           "spellings")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 2, SLICE_IDS):
            model = on_worker3()
            texts, keys, far_size, long = symbols(batch), [], [], []
            for joined in batch.column(3).to_pylist():
                far = joined.split()
                if far and max(map(len, far)) > LONG:
                    long += [(len(keys) + j, w) for j, w in enumerate(far) if len(w) > LONG]
                keys += far
                far_size.append(len(far))
            times = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int32).astype(np.int64)
            own: list[float | None] = [None] * len(keys)
            for j, w in long:
                keys[j], own[j] = key_of(w), float(spell([w], model.letters, model.spelling, model.spell_mix)[0])
            n = np.array([len(t) for t in texts])
            text_of = np.repeat(np.arange(len(texts)), n)
            ids = np.concatenate(texts)
            ln = score_ids(texts, model.tables, model.words, model.mix)
            base = np.bincount(text_of, model.log10[ids], len(texts))
            known = np.bincount(text_of, model.known[ids], len(texts)).astype(np.int64)
            m, p = len(texts), len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + m)), batch.column(0), batch.column(1), pa.array(n.astype(np.int64)),
                 batch.column(5), pa.array(known), pa.array(base), pa.array(ln),
                 pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], fields)
            if p:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.repeat(np.arange(m), far_size)), pa.nulls(p, id_arrow), pa.nulls(p, pa.bool_()),
                     pa.nulls(p, pa.int64()), pa.nulls(p, pa.int64()), pa.nulls(p, pa.int64()), pa.nulls(p, pa.float64()),
                     pa.array(own, pa.float64()), pa.array(keys, pa.binary()), pa.array(times, pa.int64())], fields)
            row += m

    fields = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "ln", "key", "n"]
    done, _ = written(texts.mapInArrow(scored, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_bytes long, "
                                              "known long, base double, ln double, key binary, n long"), "scored")
    whole.destroy()  # both tables that need it are written
    forget(spark, coded_at, rare_at)  # and nothing else reads these
    ln = F.when(F.col("c") >= 2, F.log(F.col("c") / F.lit(float(max(often["n"], 1)))) + math.log(1 - new)).otherwise(
        F.coalesce("own", "ln") + math.log(new))
    far = (done.where("key IS NOT NULL").select("row", "key", F.col("n").alias("times"), F.col("ln").alias("own"))
           .join(spellings, "key").groupBy("row").agg(
               F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(room))).alias("far_base"),
               F.sum(F.col("times") * ln).alias("far_ln"),
               F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("far_known")))
    score = (F.col("ln") + F.coalesce("far_ln", F.lit(0.0))) / math.log(10)
    return (done.where("key IS NULL").join(far, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(size).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("far_base", F.lit(0.0))).alias("base_score"), score.alias("score"), "n_bytes",
        F.when(F.col("n_bytes") > 0, -score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte")))

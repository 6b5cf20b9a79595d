"""Quality classifier: a linear-chain CRF labels every line good or bad from
its own and its neighbours' features; forward-backward marginals, weighted by
line length, aggregate into the document's quality.

Training reads labels of documents; a line takes its document's label first,
then one self-training round gives the lines of bad documents that look good
their own label. The share of good text is mapped so that the cut that
separates the training documents best lies at 0.5.

Defined results: a null or empty text is one empty line of weight one, so it
has a score too; equal texts have equal scores; no column but the text is an
input. Without labelled rows, or with one class only, every score is that
class's share (0.5 when there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.crf import Crf, fit
from gridcast.llm.texts import map_texts, rewrite_texts

#: bound on the labelled documents that the model is fitted to
TRAIN_DOCS = 3000
#: longest text of the sample, in characters
TRAIN_CHARS = 100_000

_CLASS = np.zeros(256, np.uint8)
_SIGN, _PIPE, _BANG, _UPPER, _LOWER, _DIGIT = 1, 2, 3, 4, 5, 6
for _c in b"#*$%&<>{}[]=~^\\":
    _CLASS[_c] = _SIGN
_CLASS[ord("|")] = _PIPE
_CLASS[ord("!")] = _BANG
_CLASS[ord("A"):ord("Z") + 1] = _UPPER
_CLASS[ord("a"):ord("z") + 1] = _LOWER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
#: bins per feature; the last two say whether a neighbour exists
_BINS = 8
_OWN = 11
N_FEATURES = 3 * _OWN * (_BINS + 1) + 1


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, then 1 to 7 by powers of two of the share."""
    p = part / np.maximum(whole, 1)
    return np.where(part == 0, 0, np.clip(8 + np.floor(np.log2(np.maximum(p, 1e-9))), 1, 7)).astype(np.int64)


def _log(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(x, 0) + 1)), 0, 7).astype(np.int64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line with its neighbours', lines per text, line
    lengths in bytes of words and spaces, at least one)."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    lines = [x.split(b"\n") for x in raws]
    per = np.array([len(x) for x in lines], np.int64)
    buf = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    kind = _CLASS[buf]
    count = {k: np.add.reduceat((kind == k).astype(np.int32), starts)
             for k in (_SIGN, _PIPE, _BANG, _UPPER, _LOWER, _DIGIT)}
    n_words, n_kinds, twice, final, caps = [], [], [], [], []
    for doc in lines:
        seen = set()
        for line in doc:
            words = line.split()
            n_words.append(len(words))
            n_kinds.append(len(set(words)))
            twice.append(len(words) > 0 and line in seen)
            seen.add(line)
            last = line[-1:] if line else b""
            final.append(0 if not line else 1 if last == b"." else 2 if last in b"!?:;\"')" else 3)
            caps.append(words[0][:1].isupper() if words else False)
    nw, nk = np.array(n_words, np.int64), np.array(n_kinds, np.int64)
    letters = count[_UPPER] + count[_LOWER]
    own = np.stack([
        _log(nw), _share(count[_SIGN], nw), _share(count[_PIPE], nw), _share(count[_BANG], nw),
        _share(count[_UPPER], letters), _share(count[_DIGIT], size), _share(nw - nk, nw),
        np.clip(size // np.maximum(nw, 1) // 2, 0, 7), np.array(twice, np.int64), np.array(final, np.int64),
        np.array(caps, np.int64)], 1)
    own = own + np.arange(_OWN) * (_BINS + 1)
    none = _BINS + np.arange(_OWN) * (_BINS + 1)
    at = np.cumsum(per) - per
    back, ahead = np.roll(own, 1, 0), np.roll(own, -1, 0)
    back[at] = none
    ahead[at + per - 1] = none
    third = _OWN * (_BINS + 1)
    bias = np.full((len(own), 1), 3 * third)
    every = np.concatenate([own, back + third, ahead + 2 * third, bias], 1).astype(np.int16)
    return every, per, np.maximum(size, 1)


def _in_parts(texts: list[str], size: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of many texts, some at a time."""
    parts = [line_features(texts[i:i + size]) for i in range(0, len(texts), size)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _good_share(crf: Crf, x: np.ndarray, per: np.ndarray, size: np.ndarray) -> np.ndarray:
    good = crf.marginals(x, per)[:, 1]
    at = np.cumsum(per) - per
    return np.add.reduceat(good * size, at) / np.add.reduceat(size, at)


@dataclass
class Model:
    crf: Crf
    cut: float
    #: the constant score of a model without two classes
    constant: float | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.mapped(_good_share(self.crf, *line_features(texts)))

    def mapped(self, share: np.ndarray) -> np.ndarray:
        c = self.cut
        return np.where(share < c, 0.5 * share / c, 0.5 + 0.5 * (share - c) / (1 - c))


def fit_texts(texts: list[str], quality: np.ndarray, rounds: int = 100) -> Model:
    """Model of labelled texts (1 good, 0 bad)."""
    q = np.asarray(quality, np.int64)
    if not len(q) or q.min() == q.max():
        return Model(fit(np.zeros((0, 1), np.int64), np.zeros(0), np.zeros(0), N_FEATURES, 2), 0.5,
                     float(q[0]) if len(q) else 0.5)
    x, per, size = _in_parts(texts)
    seq = np.where(q == 1, 0.5 / (q == 1).sum(), 0.5 / (q == 0).sum())
    y = np.repeat(q, per)
    crf = fit(x, per, y, N_FEATURES, 2, rounds, token_weight=seq)
    # lines of bad documents that look good get that label, unless none would stay bad
    good = crf.marginals(x, per)[:, 1]
    at = np.cumsum(per) - per
    some_bad = np.repeat(np.minimum.reduceat(good, at) < 0.5, per)
    y2 = np.where((y == 0) & some_bad & (good > 0.6), 1, y)
    crf = fit(x, per, y2, N_FEATURES, 2, rounds, token_weight=seq)
    share = _good_share(crf, x, per, size)
    edges = np.unique(np.concatenate([share, [0.0, 1.0]]))
    cuts = np.clip((edges[1:] + edges[:-1]) / 2, 0.01, 0.99)
    s1, s0 = np.sort(share[q == 1]), np.sort(share[q == 0])
    hit = (1 - np.searchsorted(s1, cuts) / len(s1)) + np.searchsorted(s0, cuts) / len(s0)
    best = np.flatnonzero(hit >= hit.max() - 0.002)  # the middle of the cuts that are as good
    return Model(crf, float(cuts[best[0]] + cuts[best[-1]]) / 2)


def held_out(id_col: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 1 mod 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", max_chars: int = TRAIN_CHARS) -> Model:
    """Fit to at most ``max_docs`` labelled documents of at most ``max_chars``
    characters that are not held out, chosen by the hash of their ids, so the
    driver gets a bounded sample at every size of the tables. Rows that share
    an id count one by one; the bound is on rows."""
    chosen = (labels.where(~held_out(id_col)).where(F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_docs).select("text", "quality").toArrow())
    pairs = sorted(zip(rows.column("text").to_pylist(), rows.column("quality").to_pylist()))
    return fit_texts([t for t, _ in pairs], np.array([q for _, q in pairs], np.int64))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 from
    0.5 on)."""

    def work(texts: list[str]) -> list[list]:
        s = np.clip(model.scores(texts), 0.0, 1.0)
        return [s, (s >= 0.5).astype(np.int32)]

    out = map_texts(docs, id_col, text_col, "score double, predicted int", work)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def filter_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores 0.5 or more, columns as they are."""
    return rewrite_texts(docs, text_col,
                         lambda texts: (None, model.scores([t or "" for t in texts]) >= 0.5))

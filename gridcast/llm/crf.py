"""Linear-chain conditional random field in numpy, over many sequences at once.

A token is a row of F feature indices; its label scores are the sum of their
weight rows. Sequences of any length are handled as a packed, time-major
array (step t holds the sequences longer than t), so there is no padding and
one numpy operation per step serves all sequences of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Packed:
    """Time-major packing of sequences of the given lengths (all >= 1)."""

    def __init__(self, lens: np.ndarray):
        self.lens = np.asarray(lens, np.int64)
        self.order = np.argsort(-self.lens, kind="stable")
        down = self.lens[self.order]
        steps = int(down[0]) if len(down) else 0
        self.alive = np.searchsorted(-down, -np.arange(steps), side="left")
        self.off = np.concatenate([[0], np.cumsum(self.alive)]).astype(np.int64)
        rank = np.empty(len(down), np.int64)
        rank[self.order] = np.arange(len(down))
        starts = np.cumsum(self.lens) - self.lens
        seq = np.repeat(np.arange(len(self.lens)), self.lens)
        t = np.arange(int(self.lens.sum())) - starts[seq]
        #: place in the packed array of each token in reading order
        self.place = self.off[t] + rank[seq]

    def pack(self, flat: np.ndarray) -> np.ndarray:
        out = np.empty_like(flat)
        out[self.place] = flat
        return out

    def step(self, t: int) -> slice:
        return slice(self.off[t], self.off[t + 1])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Crf:
    weights: np.ndarray  # features x labels
    trans: np.ndarray  # from x to
    first: np.ndarray  # labels

    def scores(self, feats: np.ndarray) -> np.ndarray:
        out = np.zeros((len(feats), self.weights.shape[1]))
        for j in range(feats.shape[1]):
            out += self.weights[feats[:, j]]
        return out

    def viterbi(self, feats: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Best label of each token, in reading order."""
        return self.decode(self.scores(feats), lens) if len(lens) else np.zeros(0, np.int64)

    def decode(self, scores: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Best label of each token of given label scores, in reading order."""
        if not len(lens):
            return np.zeros(0, np.int64)
        p = Packed(lens)
        e, n = p.pack(scores), len(p.alive)
        back = np.zeros(e.shape, np.int8)
        best = np.zeros(e.shape)
        best[p.step(0)] = e[p.step(0)] + self.first
        for t in range(1, n):
            came = best[p.step(t - 1)][: p.alive[t], :, None] + self.trans[None]
            back[p.step(t)] = came.argmax(1)
            best[p.step(t)] = e[p.step(t)] + came.max(1)
        labels = best.argmax(1)
        for t in range(n - 2, -1, -1):
            m = p.alive[t + 1]
            after = labels[p.off[t + 1]: p.off[t + 2]]
            labels[p.off[t]: p.off[t] + m] = back[p.step(t + 1)][np.arange(m), after]
        return labels[p.place]

    def forward_backward(self, e: np.ndarray, p: Packed) -> tuple[np.ndarray, np.ndarray]:
        a, b, n = np.zeros(e.shape), np.zeros(e.shape), len(p.alive)
        a[p.step(0)] = e[p.step(0)] + self.first
        for t in range(1, n):
            a[p.step(t)] = e[p.step(t)] + _lse(
                a[p.step(t - 1)][: p.alive[t], :, None] + self.trans[None], 1)
        for t in range(n - 2, -1, -1):
            m = p.alive[t + 1]
            after = e[p.step(t + 1)] + b[p.step(t + 1)]
            b[p.off[t]: p.off[t] + m] = _lse(self.trans[None] + after[:, None, :], 2)
        return a, b

    def marginals(self, feats: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Label probabilities of each token, in reading order."""
        if not len(lens):
            return np.zeros((0, self.weights.shape[1]))
        p = Packed(lens)
        a, b = self.forward_backward(p.pack(self.scores(feats)), p)
        s = a + b
        return np.exp(s - _lse(s, 1)[:, None])[p.place]


def fit(feats: np.ndarray, lens: np.ndarray, labels: np.ndarray, n_features: int, n_labels: int,
        rounds: int = 150, rate: float = 0.15, l2: float = 1e-3,
        token_weight: np.ndarray | None = None) -> Crf:
    """Penalised maximum likelihood by full-batch Adam. ``token_weight``
    weighs whole sequences (one value per sequence). An empty table gives a
    model of zeros, which labels everything 0."""
    crf = Crf(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    if not len(lens):
        return crf
    p = Packed(lens)
    x, y = p.pack(feats), p.pack(labels)
    w = np.ones(len(lens)) if token_weight is None else np.asarray(token_weight, float)
    w = w / w.sum()
    wt = p.pack(np.repeat(w, p.lens))
    wseq = w[p.order]
    n, hot = len(p.alive), np.eye(n_labels)
    params = [crf.weights, crf.trans, crf.first]
    m1, m2 = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for i in range(1, rounds + 1):
        e = p.pack(crf.scores(feats))
        a, b = crf.forward_backward(e, p)
        s = a + b
        z = _lse(s[p.step(0)], 1)
        diff = (np.exp(s - _lse(s, 1)[:, None]) - hot[y]) * wt[:, None]
        g = np.empty_like(crf.weights)
        for k in range(n_labels):
            g[:, k] = np.bincount(x.ravel(), np.repeat(diff[:, k], x.shape[1]), n_features)
        gt = np.zeros_like(crf.trans)
        for t in range(1, n):
            k = p.alive[t]
            pair = np.exp(a[p.step(t - 1)][:k, :, None] + crf.trans[None]
                          + (e[p.step(t)] + b[p.step(t)])[:, None, :] - z[:k, None, None])
            gt += (pair * wseq[:k, None, None]).sum(0)
            np.add.at(gt, (y[p.step(t - 1)][:k], y[p.step(t)]), -wseq[:k])
        grads = [g, gt, diff[p.step(0)].sum(0)]
        for q, gq, u, v in zip(params, grads, m1, m2):
            gq = gq + l2 * q / max(1, len(lens)) * 10
            u *= 0.9
            u += 0.1 * gq
            v *= 0.99
            v += 0.01 * gq * gq
            q -= rate * (u / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-9)
    return crf

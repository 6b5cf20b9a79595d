"""Operators that read every line and learn from every text."""

import random
import zlib

import numpy as np
import pytest

from gridcast.llm import context_mixing as cm
from gridcast.llm import secret_scan, tagging


def slow_spans(text, model):
    """Added spans by the features of every line, one line after the other."""
    base, out, at = secret_scan.base_spans(text), [], 0
    for line in text.split("\n"):
        if toks := [m.span() for m in secret_scan._TOKEN.finditer(line)]:
            x = tagging.features(secret_scan._rows(line, toks), secret_scan.file_features(text))
            for _, a, b in tagging.runs(model.viterbi(x, np.array([len(toks)])), {1: "secret"}, {2: "secret"}):
                s, e = at + toks[a][0], at + toks[b][1]
                if not any(s < y and x < e for _, x, y in base):
                    out.append(("secret", s, e))
        at += len(line) + 1
    return sorted(base + out, key=lambda v: (v[1], secret_scan.KINDS.index(v[0]), v[2]))


def test_secrets_on_lines_without_a_cue_or_a_long_run():
    model = secret_scan.train()
    got = secret_scan.spans_of(["call me Tr0ub4dor&3 now", "first line\nlogin: admin hunter2x9\nlast", "Donaudampfschifffahrt and on."], model)[1]
    assert got == [[("secret", 8, 19)], [("secret", 24, 33)], []]


def test_secrets_of_every_line_against_plain_features():
    model, r = secret_scan.train(), random.Random(3)
    parts = ["key", "_", "=", ":", " ", " ", "\n", "Ab1", "zz9", "&", "AKIA", "hunter2x9", "😀", "é", ".", " password ", "a" * 20,
             "Tr0ub4dor&3", "token: abcdefgh", "\r", "\x0b", "'", "0123456789abcdef" * 2]
    texts = ["", "\n", "x", "\n\n a\n", *("".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400))]
    want = [slow_spans(t, model) for t in texts]
    assert sum(k == "secret" for spans in want for k, _, _ in spans) > 100
    assert secret_scan.spans_of(texts, model)[1] == want
    reader = secret_scan.Reader(model)  # kept from batch to batch
    assert [secret_scan.spans_of([t], reader)[1][0] for t in texts] == want


def test_counts_and_weights_are_learnt_from_every_training_text(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") + r.choice("xyz") + str(r.randint(0, 9)) for _ in range(r.randint(0, 9))) for _ in range(200)]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = []
    for name in ("_counted", "_fitted"):
        def noted(frame, *more, name=name, real=getattr(cm, name)):
            seen.append((name, frame.count()))
            return real(frame, *more)
        monkeypatch.setattr(cm, name, noted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert cm.score_documents(docs, n_words=40, slot_bits=16).count() == 200
    words = len({w for t in train for w in t.split()})
    assert seen == [("_counted", len(train)), ("_counted", words), ("_fitted", len(train)), ("_fitted", words)]


def test_a_fit_does_not_see_the_bit_itself():
    counts = np.array([[3, 0], [0, 1], [5, 60], [0, 0]], np.uint16)
    got = cm.TablesWithout(counts)
    for slot, (zero, one) in enumerate(counts.tolist()):
        for bit in (0, 1):
            less = np.array([[max(zero - (bit == 0), 0), max(one - (bit == 1), 0)]], np.uint16)
            assert got.inputs(np.array([slot]), np.array([bit], np.float32))[0] == cm.Tables(less).inputs(np.array([0]))[0]


def test_fit_of_several_tasks_is_the_logistic_regression():
    r, k = np.random.default_rng(5), 3
    x = r.normal(0, 1.5, (k, 60_000)).astype(np.float32)
    gate = np.repeat([0, 7], 30_000)
    true = np.array([[0.6, 0.3, -0.2], [0.1, 0.9, 0.4]])
    bit = (r.random(60_000) < 1 / (1 + np.exp(-(true[(gate == 7).astype(int)] * x.T).sum(axis=1)))).astype(np.float32)
    order, sums = r.permutation(60_000), 0
    for task in np.array_split(order, 3):
        fit = cm.Fit(k)
        for some in np.array_split(task, 10):
            fit.step(gate[some], x[:, some], bit[some])
        sums = sums + fit.sums()
    got = cm.Fit.joined(sums, k)
    assert got[[0, 7]] == pytest.approx(true, abs=0.06)
    assert got[[1, 23]] == pytest.approx(1 / 3)
    twice, once = cm.Fit(k), cm.Fit(k)
    once.step(gate[:50], x[:, :50], bit[:50], np.full(50, 2))
    twice.step(np.tile(gate[:50], 2), np.tile(x[:, :50], 2), np.tile(bit[:50], 2))
    assert once.weights == pytest.approx(twice.weights, abs=1e-5)


def test_spelling_by_distinct_grams_is_that_of_every_byte():
    spelling = cm.SpellContexts()
    letters = cm.Tables(np.random.default_rng(2).integers(0, 30, (spelling.size, 2)).astype(np.uint16))
    weights = np.random.default_rng(3).normal(0.3, 0.2, (cm.GATES, 4)).astype(np.float32)
    words = [b"banana", b"", "ünï".encode(), b"anan", b"b" * 70, b"banana"]
    want = []
    for w in words:
        slots, bit, deep = spelling.bits(spelling.grams([w])[1])
        x = letters.inputs(slots)
        mixed = (weights[letters.gate(x, deep)].T * x).sum(axis=0)
        want.append(-np.log1p(np.exp(-np.clip(mixed, -14, 14) * (bit * 2 - 1))).sum())
    assert cm.spell(words, letters, spelling, weights) == pytest.approx(want, rel=1e-4)


def test_texts_are_split_twice_only_and_scratch_is_given_back(spark, monkeypatch, tmp_path):
    """The passes over contexts read symbols, not texts; what they read is deleted once scored."""
    read, tables = [], []
    for name in ("_counted", "_fitted"):
        def noted(frame, *more, real=getattr(cm, name)):
            read.append((frame.columns, sorted(map(bytes, frame.toPandas()["ids"])) if "ids" in frame.columns else None))
            return real(frame, *more)
        monkeypatch.setattr(cm, name, noted)

    def kept(df, name, real=cm.written):
        out, path = real(df, name)
        tables.append((name, path))
        return out, path
    monkeypatch.setattr(cm, "written", kept)
    texts = ["b b a rare", "A b\tb", None, "b \u00fcnsean a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1], "doc_id long, text string")
    texts = [r.text for r in docs.collect()]
    got = cm.score_documents(docs, n_words=40, slot_bits=16)
    assert "text" not in {c for columns, _ in read for c in columns}
    count = sorted(w for t in texts for w in (t or "").lower().split())
    listed = sorted({w for w in count if count.count(w) >= 2}, key=lambda w: (-count.count(w), w.encode()))
    want = [np.array([listed.index(w) + 2 if w in listed else 1 for w in (t or "").lower().split()] + [0], np.uint16) for t in texts]
    symbols = [ids for _, ids in read if ids is not None]
    assert symbols == [sorted(w.tobytes() for w in want)] * 2
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    there = {n for n, p in tables if fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p))}
    assert there == {"spellings", "scored"}
    assert got.count() == len(texts)


def test_context_counts_and_paths_against_plain_loops():
    r = np.random.default_rng(8)
    code = cm.Code([5, 3, *range(1, 31)])
    contexts = cm.WordContexts(code, 16)
    texts = [r.integers(0, 32, n).astype(np.int32) for n in (1, 2, 3, 700, 9000)]
    table = np.zeros((contexts.size, 2), np.int64)
    cm.count_contexts(texts, contexts, table)
    want = np.zeros_like(table)
    ids, n = np.concatenate(texts), np.array([len(t) for t in texts])
    hashes = contexts.prepared(ids, np.cumsum(n) - n)
    paths = {}
    for s in range(32):
        _, path = code.bits(np.array([s]))
        nodes, bits = path >> 3, path & 1
        assert (code.deep(path) == np.minimum(np.arange(len(path)) // 4, 3) * 6).all()
        assert nodes[0] == 0 and (code.bit(path) == bits).all()
        paths[s] = list(zip(nodes.tolist(), bits.tolist()))
    assert len({tuple(p) for p in paths.values()}) == 32
    for at, s in enumerate(ids.tolist()):
        for node, bit in paths[s]:
            for i, h in enumerate(hashes):
                slot = ((int(h[at]) ^ node * 0x85EBCA6B & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF) >> 16
                want[contexts.at[i + 1] + slot, bit] += 1
    assert (table == want).all()


def test_online_scores_against_one_bit_after_the_other():
    """The blocks' numpy against plain Python over the bits."""
    r = np.random.default_rng(9)
    contexts = cm.WordContexts(cm.Code([5, 3, *range(1, 31)]), 16)
    tables = cm.Tables(r.integers(0, 40, (contexts.size, 2)).astype(np.uint16))
    start = r.normal(0.3, 0.3, (cm.GATES, 3)).astype(np.float32)
    ids = r.integers(0, 32, 150).astype(np.int32)
    hashes, weights, fine, want = contexts.prepared(ids, np.zeros(1, np.int64)), start.astype(float), np.zeros(cm.BINS), 0.0
    for first, size in cm.blocks(len(ids)):
        pull, firm = np.zeros((cm.GATES, 3)), np.zeros(cm.GATES)
        push, slacks = np.zeros(cm.BINS), np.zeros(cm.BINS)
        for at in range(first, min(first + size, len(ids))):
            n, paths = contexts.code.bits(ids[at:at + 1])
            x = tables.inputs(contexts.slots(hashes, slice(at, at + 1), n, paths))
            for g, v, bit in zip(tables.gate(x, contexts.code.deep(paths)), x.T.astype(float), contexts.code.bit(paths)):
                mixed = min(max(float(weights[g] @ v), -14), 14)
                cell = int(min(max((mixed + 8) * 2, 0), cm.BINS - 1))
                right = 1 / (1 + np.exp(-(mixed + fine[cell]) * (2 * bit - 1)))
                want += np.log(right)
                error, slack = (1 - right) * (2 * bit - 1), right * (1 - right)
                pull[g] += error * v
                firm[g] += slack * (v @ v)
                push[cell] += error
                slacks[cell] += slack
        weights += cm.RATE * pull / (1 + cm.RATE * firm)[:, None]
        fine += cm.MAP_RATE * push / (1 + cm.MAP_RATE * slacks)
    assert cm.score_ids([ids], tables, contexts, start)[0] == pytest.approx(want, rel=1e-4)

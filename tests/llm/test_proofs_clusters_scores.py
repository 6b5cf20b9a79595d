"""Merkle manifest, centroid clustering and context mixing against plain
Python on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridcast.llm import context_mixing as cm
from gridcast.llm import merkle, table_kmeans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, no int, up string, tree string, h string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars); the other columns clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "w") for r in rows], DOCS)


def slow_manifest(rows):
    groups, out = {}, []
    for k, (i, text, lang, source, n) in enumerate(rows):
        cut = text
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            cut = text.replace("\n", "")
        own, bad = (h(*map(field, (i, source, lang, n, t))) for t in (text, cut))
        groups.setdefault(source, []).append((i is not None, i or 0, own, bad, k))

    def climb(nodes):  # (digest, [(row, folded, siblings)])
        while len(nodes) > 1:
            up = []
            for a in range(0, len(nodes), 3):
                run, members = nodes[a:a + 3], []
                for j, (_, below) in enumerate(run):
                    left, right = "".join(x[0] for x in run[:j]), "".join(x[0] for x in run[j + 1:])
                    members += [(k, h(left, f, right), s + left + right) for k, f, s in below]
                up.append((h(*[x[0] for x in run]), members))
            nodes = up
        return nodes[0]

    tops, subs, leaf = [], {}, {}
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        nodes = []
        for _, _, own, bad, k in sorted(groups[source]):
            leaf[k] = own
            nodes.append((own, [(k, bad, "")]))
        top = climb(nodes)
        subs[source] = top[0]
        tops.append(top)
    root, members = climb(tops) if tops else ("", [])
    for k, folded, sibs in members:
        out.append((rows[k][0], leaf[k], subs[rows[k][3]], root, h(sibs), folded, folded == root))
    return sorted(out, key=repr)


def got_manifest(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def manifest_rows(seed=2):
    r = random.Random(seed)
    rows = []
    for source, n in (("hot", 100), ("lone", 1), (None, 4), ("", 2), ("z", 10), ("é", 28), ("Z", 9), ("a", 3)):
        for _ in range(n):
            text = r.choice([None, "", "a\nb", "one line", "\n\n", "漢字\n😀", "x" * 3000 + "\n"])
            rows.append((r.choice([None, *range(60)]), text, r.choice(["en", None]), source, r.choice([None, 3])))
    rows += [(7, "same\nrow", "en", "hot", 1)] * 40  # repeated rows
    return rows


@pytest.mark.parametrize("room", [0, 30, 10_000])
def test_manifest_against_plain_python(spark, room):
    rows = manifest_rows()
    got = merkle.manifest(documents(spark, rows).repartition(3), broadcast_nodes=room)
    assert got_manifest(got) == slow_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(5, "a\nb", "en", "s", 3)], [(None, None, None, None, None)],
                                  [(i, "t\n", "en", s, 1) for s in "abcd" for i in range(1)]])
def test_small_manifests(spark, rows):
    got = merkle.manifest(documents(spark, rows))
    assert {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"} <= set(got.columns)
    assert got_manifest(got) == slow_manifest(rows)


def test_a_changed_text_is_found_and_an_unchanged_one_is_not(spark):
    rows = [(i, f"line {i}\nline", "en", "s", 1) for i in range(30)]
    got = {r.doc_id: r for r in merkle.manifest(documents(spark, rows)).collect()}
    for i in range(30):
        assert got[i].verified == (zlib.crc32(str(i).encode()) % 2 == 1) == (not got[i].tampered)


def test_the_row_limit_of_recursive_queries_is_given_back(spark):
    was = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    merkle.manifest(documents(spark, [(i, "t", "en", "s", 1) for i in range(5)])).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) == was


# ---- clusters ---------------------------------------------------------------

def slow_clusters(rows, k, rounds, dims, seed=3):
    held = lambda x: math.floor(max(min(x * 1024, table_kmeans.LIMIT), -table_kmeans.LIMIT))
    kept = [(i, [held(float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cent = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cent)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                cent[j] = [sum(c) // len(own) for c in zip(*own)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    inert = Counter()
    for _, j, d in placed:
        inert[j] += d
    return sorted(((i, j, d, inert[j], sum(inert.values()), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest())
                   for i, j, d in placed), key=repr)


def vectors(n, dims, seed=1, spread=1.0):
    r = random.Random(seed)
    rows = [(i, [r.choice([r.gauss(0, spread), 0.5, -0.5]) for _ in range(dims)]) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (900, None), (901, []), (902, [0.0] * (dims - 1)),
             (903, [float("nan")] + [0.0] * (dims - 1)), (904, [float("inf")] + [0.0] * (dims - 1)), (905, [None] + [0.0] * (dims - 1))]
    return rows + [(1000 + i, [0.25] * dims) for i in range(30)]  # many equal vectors


@pytest.mark.parametrize("n,dims,spread", [(120, 4, 1.0), (80, 6, 1e5), (40, 3, 1e30)])
def test_clusters_against_plain_python(spark, n, dims, spread):
    rows = vectors(n, dims, spread=spread)
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v double")
    got = table_kmeans.cluster_vectors(df.repartition(3), clusters=4, rounds=5, dims=dims)
    have = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()), key=repr)
    assert have == slow_clusters(rows, 4, 5, dims)


def test_fewer_vectors_than_clusters_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    one = table_kmeans.cluster_vectors(spark.createDataFrame([(1, [1.0] * 64), (2, [1.0])], schema)).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(1, 0, 0, 0)]
    assert table_kmeans.cluster_vectors(spark.createDataFrame([(2, [1.0])], schema)).collect() == []
    assert table_kmeans.cluster_vectors(spark.createDataFrame([], schema)).collect() == []


def test_tables_give_exact_distances():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-50, 50, (200, 5)), r.integers(-(1 << 27), 1 << 27, (9, 5))])
    c = r.integers(-60, 60, (3, 5))
    assert (table_kmeans.distances(x, c) == ((x[:, None] - c[None]) ** 2).sum(axis=2)).all()


# ---- scores -----------------------------------------------------------------

def texts(seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeor") for _ in range(r.randint(1, 7))) for _ in range(60)]
    out = [" ".join(r.choice(words[:1 + r.randint(0, 59)]) for _ in range(r.randint(1, 90))) for _ in range(150)]
    out += [None, "", " \t\n", "W" * 500 + " end", "UPPER upper ÜPPER", "nul\x00 \x0b mark", out[0], out[0], "a b",
            " ".join(words) * 40, "漢字 😀 " + "y" * 49 + " " + "z" * 48, "only once zzzzqqq"]
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "twice the id")]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, key string, n int, score double")
    return rows, cm.score_documents(df.repartition(4), n_words=40, slot_bits=16).collect()


def test_base_scores_against_plain_python(scored):
    rows, got = scored
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*__import__("re").findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((repr(i), held(i), len(ws), sum(count[w] > 0 for w in ws), n,
                   round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, _), ws in zip(rows, tokens))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_scores_are_finite_and_equal_for_equal_texts(scored):
    rows, got = scored
    text = dict(rows[:-2])
    by = {}
    for r in got:
        assert math.isfinite(r.score) and r.score < 0
        assert (r.bits_per_byte is None) == (r.n_bytes == 0)
        if r.doc_id is not None and r.doc_id != 3:
            by.setdefault(text[r.doc_id], []).append(r.score)
    assert all(max(s) - min(s) < 1e-3 for s in by.values())


def test_seen_prose_scores_above_unseen_letters(scored):
    rows, got = scored
    mean = lambda keep: np.mean([r.score / r.n_tokens for r in got if keep(r)])
    assert mean(lambda r: r.doc_id is not None and r.doc_id < 150 and r.held_out) > mean(lambda r: r.doc_id == len(texts()) - 1)


def test_no_training_text_and_no_text(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = cm.score_documents(spark.createDataFrame([(held, "some words some")], "doc_id long, text string")).first()
    assert (one.train_tokens, one.n_known, one.n_tokens) == (0, 0, 4) and math.isfinite(one.score)
    assert cm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def trained(words=30):
    r = np.random.default_rng(0)
    parts = {"words": [b"w%d" % i for i in range(words)], "slot_bits": 16, "weights": [5, 3, *range(1, words + 1)],
             "log10": [0.0] * (words + 2), "known": [0] * (words + 2)}
    model = cm.Model(parts)
    tables = cm.Tables(r.integers(0, 40, (model.words.size, 2)).astype(np.uint16))
    return model, tables, r.normal(0.3, 0.3, (cm.GATES, 3)).astype(np.float32)


def test_symbol_probabilities_add_up_to_one():
    """With any tables, weights and history the next symbol's probabilities are a distribution."""
    model, tables, weights = trained()
    for history in ([], [4, 9], list(range(2, 30)) * 3):
        before = cm.score_ids([np.array(history, np.int32)], tables, model.words, weights)[0] if history else 0.0
        after = [cm.score_ids([np.array([*history, s], np.int32)], tables, model.words, weights)[0] for s in range(32)]
        assert sum(math.exp(x - before) for x in after) == pytest.approx(1, abs=2e-3)


def test_spellings_are_a_code():
    model, tables, _ = trained()
    letters = cm.Tables(np.random.default_rng(1).integers(0, 30, (model.spelling.size, 2)).astype(np.uint16))
    weights = np.full((cm.GATES, 4), 0.25, np.float32)
    ends = cm.spell([b"", *[bytes([c]) for c in range(256) if c != 32]], letters, model.spelling, weights)
    assert math.exp(ends[0]) + sum(math.exp(x) for x in ends[1:]) < 1 + 1e-3
    together = cm.spell([b"abc", b"x" * 9000, b"abc"], letters, model.spelling, weights)
    assert together[0] == pytest.approx(together[2]) == pytest.approx(cm.spell([b"abc"], letters, model.spelling, weights)[0])


def test_learning_within_a_text_pays():
    """A text that repeats itself costs less per word later: the weights move online."""
    model, tables, weights = trained()
    many, few = np.tile(np.array([3, 5, 7, 9], np.int32), 500), np.tile(np.array([3, 5, 7, 9], np.int32), 8)
    a = cm.score_ids([many], tables, model.words, weights)[0] / len(many)
    b = cm.score_ids([few], tables, model.words, weights)[0] / len(few)
    assert a > b


def test_texts_side_by_side_score_as_alone():
    model, tables, weights = trained()
    r = np.random.default_rng(2)
    many = [r.integers(0, 32, n).astype(np.int32) for n in (1, 5, 31, 32, 33, 400, 5000, 7)]
    together = cm.score_ids(many, tables, model.words, weights)
    alone = [cm.score_ids([t], tables, model.words, weights)[0] for t in many]
    assert together == pytest.approx(alone, rel=1e-4)


def test_huffman_code_is_complete_and_short_for_frequent_symbols():
    code = cm.Code([1, 1, 2, 4, 8, 100])
    assert sum(2.0 ** -n for n in code.length) == 1.0 and code.length[5] == 1 == code.length.min()


# ---- the packing program ----------------------------------------------------

def fewest(items, capacity):
    """Fewest sequences, by trying every subset in turn (small cases)."""
    n, full = len(items), (1 << len(items)) - 1
    best = [(n + 1, 0)] * (full + 1)
    best[0] = (1, 0)  # sequences used, room taken in the last
    for mask in range(1, full + 1):
        for i in range(n):
            if mask >> i & 1:
                used, taken = best[mask ^ (1 << i)]
                got = (used, taken + items[i]) if taken + items[i] <= capacity else (used + 1, items[i])
                best[mask] = min(best[mask], got)
    return best[full][0] if items else 0


def test_packing_against_the_exact_optimum():
    from gridcast.llm import packing
    r = random.Random(8)
    for _ in range(60):
        items = [r.randint(1, 12) for _ in range(r.randint(1, 10))]
        hist = dict(Counter(items))
        out, report = packing.solve(hist, 12)
        got = Counter()
        for config, n in out:
            assert sum(k * a for k, a in config) <= 12
            for k, a in config:
                got[k] += a * n
        assert got == Counter(hist) and sum(n for _, n in out) == report.sequences
        best = fewest(items, 12)
        assert report.bound <= best + 1e-9 and best <= report.sequences <= best + 1


def test_packing_program_covers_dense_histograms():
    from gridcast.llm import packing
    r = np.random.default_rng(3)
    for draws in (np.exp(r.normal(4, 1, 200_000)), r.integers(1, 513, 60_000), r.integers(150, 330, 60_000)):
        hist = {int(k): int(n) for k, n in Counter(np.clip(draws, 1, 512).astype(int).tolist()).items()}
        out, report = packing.solve(hist, 512)
        got = Counter()
        for config, n in out:
            for k, a in config:
                got[k] += a * n
        assert got == Counter(hist)
        assert report.by_program > 0.98 and report.gap < 0.02
        assert report.sequences <= 1.02 * report.bound + 1
    assert packing.solve({}, 512)[0] == []


def test_full_and_partial_pricing_agree_with_brute_force():
    from gridcast.llm import packing
    r = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.unique(r.integers(1, 30, 5))
        value = r.uniform(0.1, 3, len(lengths))
        best, last = packing.price(value, lengths, 30)
        some = packing.price_some(value, lengths, 30)[-1]
        plain = [0.0] * 31
        for room in range(1, 31):
            plain[room] = max([plain[room - 1]] + [plain[room - k] + v for k, v in zip(lengths, value) if k <= room])
        assert best == pytest.approx(plain) and some == pytest.approx(plain)

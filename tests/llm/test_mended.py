"""Cases that once crashed, were cut off or cost the square of a text."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridcast.llm import iblt, line_clean, line_quality, pii, secret_scan, simhash, url_lists


def test_parts_of_thousands_of_zeros():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    _, spans = pii.spans_of(["0" * 6000 + ".1.1.1", "1.2.3." + "4" * 9000], pii.train())
    assert [s[0][0] if s else None for s in spans] == ["ip", None]


@pytest.mark.parametrize("line,found", [("write to john at example dot com today", True), ("look at the dot", False),
                                        ("nothing here", False)])
def test_an_email_in_words(line, found):
    _, (spans,) = pii.spans_of([line], pii.train())
    assert [k for k, _, _ in spans] == (["email"] if found else [])


def scores(module, table_seed, kinds=False):
    """(precision, recall) of the model's spans on labelled lines of another seed."""
    model, table = module.train(), module.labelled_table(seed=table_seed)
    _, got = module.spans_of([t for t, _ in table], model)
    hit = wrong = missed = 0
    for (_, want), spans in zip(table, got):
        want = {(x[-2], x[-1]) for x in want}
        for s, e in want:
            near = any(a < e and s < b for _, a, b in spans)
            hit, missed = hit + near, missed + (not near)
        wrong += sum(not any(a < e and s < b for s, e in want) for _, a, b in spans)
    return hit / (hit + wrong), hit / (hit + missed)


def test_personal_data_on_lines_not_learnt_from():
    precision, recall = scores(pii, 99)
    assert precision >= 0.85 and recall >= 0.9


def test_secrets_on_lines_not_learnt_from():
    precision, recall = scores(secret_scan, 99)
    assert precision >= 0.85 and recall >= 0.85


@pytest.mark.parametrize("text", ["id 3f2b8c1e-9d4a-4e7b-8a6f-1c2d3e4f5a6b", 'integrity sha512-' + "aB3x" * 21 + "==",
                                  "order 123-456-7890", "SSN 123-45-6789"])
def test_what_is_neither_a_secret_nor_a_phone(text):
    for module in (pii, secret_scan):
        _, (spans,) = module.spans_of([text], module.train())
        assert [s for s in spans if s[0] in ("phone", "secret")] == []


def test_long_letters_in_mixed_case_are_read():
    text = "aws AbCdEfGhIjKlMnOpQrStUvWxYzAbCdEfGhIjKlMnOp"
    _, (spans,) = secret_scan.spans_of([text], secret_scan.train())
    assert spans == [("secret", 4, len(text))]


def seconds(work):
    at = time.perf_counter()
    work()
    return time.perf_counter() - at


@pytest.mark.parametrize("module,line", [(pii, "host 10.0.0.%d up\n"), (secret_scan, "token=abcdefgh%d\n")])
def test_many_base_spans_cost_no_square(module, line):
    model = module.train()
    text = lambda n: "".join(line % (i % 200) for i in range(n))
    module.spans_of([text(200)], model)
    small, large = seconds(lambda: module.spans_of([text(2000)], model)), seconds(lambda: module.spans_of([text(16000)], model))
    assert large < 8 * 2.5 * small  # eight times the lines


def test_long_boilerplate_lines():
    cookie = "we use cookies to make this page better for you and all who visit it " * 2 + "please accept cookies and read our privacy policy now."
    assert len(cookie.split()) > 35
    assert line_clean.line_fails(cookie.encode(), cookie.encode().split(), line_clean.Rules()) == "boilerplate"
    prose = ("the house stood on a hill and many came to read more of it " * 12).strip() + "."
    assert line_clean.line_fails(prose.encode(), prose.encode().split(), line_clean.Rules()) == ""
    for line in ("Alle Rechte vorbehalten heute.", "Cliquez ici pour la suite.", "Todos los derechos reservados hoy."):
        assert line_clean.line_fails(line.encode(), line.encode().split(), line_clean.Rules()) == "boilerplate"


def test_a_difference_that_never_peels_is_counted(spark):
    pairs = spark.createDataFrame([((1, "e"), [1, 2, 2, 3], [2, 3, 3, 9]), ((2, "x"), [], []), ((3, "e"), [5] * 7, [])],
                                  "pair struct<row:long,of:string>, a array<long>, b array<long>")
    for attempts in (0, 6):
        got = {r.pair.row: r.gone for r in iblt._peel_rows(pairs, attempts=attempts).collect()}
        assert {k: v or 0 for k, v in got.items()} == {1: 4, 2: 0, 3: 7}


def urls(spark, entries, captures):
    import datetime
    day = lambda n: datetime.date(2024, 1, n)
    e = spark.createDataFrame([("l", k, p, "add", day(1)) for k, p in entries], "list string, kind string, pattern string, action string, dated date")
    c = spark.createDataFrame([(i, u, day(5)) for i, u in enumerate(captures)], "page_id long, url string, fetched_at date")
    return {r.page_id: r.matched for r in url_lists.judge_captures(c, e).collect()}


def test_patterns_are_normalised_and_ipv6_hosts_found(spark):
    got = urls(spark, [("domain", "Example.COM."), ("prefix", "Shop.org//a/b/"), ("host", "[2001:DB8::1]")],
               ["http://www.example.com/x", "https://shop.org/a/b/c", "https://shop.org/a//b", "https://shop.org/a/bc",
                "http://[2001:db8::1]:8080/p", "http://user@EXAMPLE.com:80", "http://[::2]/", None])
    assert got == {0: "l=domain:example.com", 1: "l=prefix:shop.org/a/b", 2: "l=prefix:shop.org/a/b", 3: "",
                   4: "l=host:[2001:db8::1]", 5: "l=domain:example.com", 6: "", 7: ""}


def test_very_long_urls_cost_no_square(spark):
    long = "http://h.org/" + "/".join(["part"] * 200_000) + "?q"
    start = time.perf_counter()
    assert urls(spark, [("prefix", "h.org/part/part")], [long, "http://" + "a." * 60_000 + "org/"])[0] == "l=prefix:h.org/part/part"
    assert time.perf_counter() - start < 60


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_quality, "fit_texts", lambda texts, labels: seen.append((len(texts), max(map(len, texts)))))
    own, other = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.range(10_000).select(F.lit(own).cast("long").alias("doc_id"), F.lit("a line").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(other, "x" * 5000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(own, 1), (other, 0), (999, None)], "doc_id long, quality int")
    line_quality.train(docs, labels, max_docs=50, max_chars=1000)
    assert seen == [(50, 6)]


def test_pipeline_stages_keep_columns_of_any_name(spark):
    r = random.Random(1)
    rows = [(i % 7 if i else None, " ".join(r.choice("abcdefgh") * 4 for _ in range(60)), "in", "keep", "r", "k", i) for i in range(20)]
    rows += rows[:5]
    names = "doc_id long, text string, _row string, _keep string, row string, own string, `a.b` long"
    df = spark.createDataFrame(rows, names)
    out = simhash.drop_near_duplicates(df)
    assert out.schema == df.schema and out.count() == 20
    assert corpus_pipeline.near_duplicates(spark, df, "").columns == df.columns

"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A sketch has three tables of ``cells`` cells. Each paragraph (a line with a
sign) is a 40-bit digest that goes to one cell of each table, where counts,
digests and check sums add up, so repeated paragraphs count as often as they
stand. Two sketches subtract cell by cell: what both versions share cancels.
Peeling then takes a cell that holds one digest only, removes that digest from
its three cells, and so on until the difference is recovered. If cells
remain, the sketch was too small for the difference and is made anew, larger;
the largest size in a row is followed by one whose cells are rows of a table,
sized by the texts and peeled by grouped sums, so a very long text never
sits in one task's loop.

All of it is DataFrame functions. The next document is found from the ids
alone, range-partitioned; a document's text moves once by its id and the
needed third of it once more to the document before.

Defined results: a null text is the empty text, with an empty sketch;
likeness is shared paragraphs over all paragraphs (multisets), 1 for two
empty ones; equal texts have equal fingerprints; rows that repeat an id are
each fingerprinted, and stand as one place in the order of documents (the
least text's start is what the document before takes); a null id comes last;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.session import scratch_path

#: cells of each of the three tables, in the fingerprint and in its retries
CELLS = 12
RETRY = (24, 96)
ROUNDS = 8
_DIGEST = (1 << 40) - 1


def paragraphs(text: Column) -> Column:
    """40-bit digests of the lines that hold more than white space."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.transform(lines, lambda x: F.xxhash64(x).bitwiseAND(F.lit(_DIGEST)))


def check_sum(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77)).bitwiseAND(F.lit((1 << 30) - 1))


def cell_of(key: Column, table: int, cells: Column | int) -> Column:
    """1-based cell of a digest in a table."""
    return (F.pmod(F.xxhash64(key, F.lit(table)), F.lit(cells) if isinstance(cells, int) else cells) + 1).cast("int")


def _empty(cells: int) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s"))
    return F.array_repeat(zero, cells)


def _put(table: Column, at: Column, key: Column, times: Column) -> Column:
    """The table with ``times`` copies of a digest added to a cell."""
    cell = F.element_at(table, at)
    new = F.struct((cell["n"] + times).alias("n"), (cell["k"] + key * times).alias("k"),
                   (cell["s"] + check_sum(key) * times).alias("s"))
    return F.concat(F.slice(table, F.lit(1), at - 1), F.array(new), F.slice(table, at + 1, F.size(table)))


def sketch(keys: Column, cells: int) -> list[Column]:
    """Three tables of cells."""
    one = F.lit(1).cast("long")

    def table(t: int) -> Column:
        return F.aggregate(keys, _empty(cells), lambda acc, k: _put(acc, cell_of(k, t, cells), k, one))

    return [table(t) for t in range(3)]


def subtract(a: list[Column], b: list[Column]) -> list[Column]:
    return [F.zip_with(x, y, lambda p, q: F.struct(
        (p["n"] - q["n"]).alias("n"), (p["k"] - q["k"]).alias("k"), (p["s"] - q["s"]).alias("s")))
        for x, y in zip(a, b)]


def single(cell) -> tuple[Column, Column]:
    """(the digest, whether the cell holds copies of that one digest only)."""
    n, k, s = cell["n"], cell["k"], cell["s"]
    part = F.call_function("div", k, F.when(n == 0, F.lit(1).cast("long")).otherwise(n))
    pure = (F.when(n == 0, F.lit(False)).when(n == 1, check_sum(k) == s).when(n == -1, check_sum(-k) == -s)
            .otherwise((part * n == k) & (check_sum(part) * n == s)))
    return F.when(n == 1, k).when(n == -1, -k).otherwise(part), pure


def peel(diff: list[Column], cells: int, rounds: int = ROUNDS) -> Column:
    """Copies recovered, of either version; null if cells remain."""
    start = F.struct(*[d.alias(f"t{t}") for t, d in enumerate(diff)], F.lit(0).cast("long").alias("gone"))

    def found(state: Column) -> Column:
        every = F.filter(F.concat(state["t0"], state["t1"], state["t2"]), lambda c: single(c)[1])
        return F.array_distinct(F.transform(every, lambda c: F.struct(single(c)[0].alias("key"), c["n"].alias("n"))))

    def without(state: Column, hit: Column) -> Column:
        return F.struct(*[_put(state[f"t{t}"], cell_of(hit["key"], t, cells), hit["key"], -hit["n"]).alias(f"t{t}")
                          for t in range(3)], (state["gone"] + F.abs(hit["n"])).alias("gone"))

    def end(state: Column) -> Column:
        left = F.exists(F.concat(state["t0"], state["t1"], state["t2"]),
                        lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["s"] != 0))
        return F.when(~left, state["gone"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start,
                       lambda state, _: F.aggregate(found(state), state, without), end)


def as_text(tables: list[Column], cells: int) -> Column:
    """The sketch as a string: cells as count.digests.checks in hex."""
    cell = F.transform(F.concat(*tables), lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["s"])))
    return F.concat(F.lit(f"iblt3x{cells}:"), F.lower(F.array_join(cell, ",")))


def next_in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, need) by descending doc_id, the last one's next being
    the first; ``need`` is how many code points a document takes from its
    next. The ids are range-partitioned and written; each partition finds its
    own neighbours and only the partitions' first ids are joined across."""
    spark = docs.sparkSession
    at = scratch_path(spark, "order")
    (docs.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("need"))
     .repartitionByRange(F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id())
     .write.parquet(at))
    ids = spark.read.parquet(at)
    firsts = sorted((r["part"], r["first"]) for r in  # as many rows as partitions
                    ids.groupBy("part").agg(F.max("doc_id").alias("first")).collect())
    ring = [(p, firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)]
    kind = ids.schema["doc_id"].dataType.simpleString()
    across = F.broadcast(spark.createDataFrame(ring, f"part int, across {kind}"))
    own = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last())
    return (ids.withColumn("_more", F.lead(F.lit(True)).over(own)).withColumn("_next", F.lead("doc_id").over(own))
            .join(across, "part")
            .select("doc_id", F.when(F.col("_more"), F.col("_next")).otherwise(F.col("across")).alias("next_id"), "need"))


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the digests of the text (a), its
    edited version (e) and the next document (x). In the edited text the last
    third of the code points gives way to the start of the next document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = next_in_order(base).select(F.col("doc_id").alias("to_id"), "next_id", "need")
    heads = (base.join(order, F.col("doc_id").eqNullSafe(F.col("next_id")))
             .groupBy("to_id").agg(F.min(F.struct(
                 F.substring("text", F.lit(1), F.col("need")).alias("head"), paragraphs(F.col("text")).alias("x"))).alias("v")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("v.head", F.lit(1), third))
    return (base.join(heads, F.col("doc_id").eqNullSafe(F.col("to_id")))
            .select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("v.x").alias("x"))
            .select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("e"), "x"))


def _peel_rows(pairs: DataFrame, attempts: int = 6) -> DataFrame:
    """(pair, gone) for digests too many for a row's loop. ``pairs`` has
    pair, a, b; the cells are rows, 1.8 a digest, more at each attempt."""
    spark = pairs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        at = scratch_path(spark, name)
        df.write.parquet(at)
        return spark.read.parquet(at)

    def in_cells(keys: DataFrame) -> DataFrame:
        where = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), cell_of(F.col("key"), t + 3, F.col("cells")).alias("cell"))
                                    for t in range(3)]))
        return (keys.withColumn("w", where).select(
            "pair", "cells", "w.t", "w.cell", "n", (F.col("key") * F.col("n")).alias("k"),
            (check_sum(F.col("key")) * F.col("n")).alias("s")))

    def summed(cells: DataFrame) -> DataFrame:
        return (cells.groupBy("pair", "cells", "t", "cell")
                .agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"))
                .where("n <> 0 or k <> 0 or s <> 0"))

    out, todo = None, written(pairs, "pairs")
    for attempt in range(attempts):
        room = F.ceil((F.size("a") + F.size("b")) * 0.6 * (1 + attempt)).cast("int") + 8 + attempt
        sized = todo.withColumn("cells", room)
        keys = (sized.select("pair", "cells", F.explode("a").alias("key"), F.lit(1).cast("long").alias("n"))
                .unionByName(sized.select("pair", "cells", F.explode("b").alias("key"), F.lit(-1).cast("long").alias("n"))))
        cells, hits = written(summed(in_cells(keys)), "cells"), []
        while True:
            key, pure = single({c: F.col(c) for c in ("n", "k", "s")})
            hit = written(cells.where(pure).select("pair", "cells", key.alias("key"), "n").distinct(), "hits")
            if not hit.take(1):
                break
            hits.append(hit)
            cells = written(summed(cells.unionByName(in_cells(hit.withColumn("n", -F.col("n"))))), "cells")
        failed = cells.select("pair").distinct()
        gone = todo.select("pair").join(failed, "pair", "left_anti").withColumn("n", F.lit(0).cast("long"))
        for hit in hits:
            gone = gone.unionByName(hit.join(failed, "pair", "left_anti").select("pair", F.abs("n").alias("n")))
        gone = gone.groupBy("pair").agg(F.sum("n").alias("gone"))
        out = gone if out is None else out.unionByName(gone)
        if not cells.take(1):
            return out
        todo = written(todo.join(failed, "pair", "left_semi"), "pairs")
    return out.unionByName(_counted_difference(todo)) if out is not None else _counted_difference(todo)


def _counted_difference(pairs: DataFrame) -> DataFrame:
    """(pair, gone) without a sketch: digests counted on both sides. The exact
    way for what peels at none of the sizes."""
    keys = (pairs.select("pair", F.explode("a").alias("key"), F.lit(1).cast("long").alias("n"))
            .unionByName(pairs.select("pair", F.explode("b").alias("key"), F.lit(-1).cast("long").alias("n"))))
    gone = (keys.groupBy("pair", "key").agg(F.abs(F.sum("n")).alias("n")).groupBy("pair").agg(F.sum("n").alias("gone")))
    return pairs.select("pair").join(gone, "pair", "left").select("pair", F.coalesce("gone", F.lit(0).cast("long")).alias("gone"))


def likeness(a: Column, b: Column, gone: Column) -> Column:
    """Shared over all paragraphs of two multisets, from the recovered difference."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - gone) / (total + gone))


def fingerprint_documents(docs: DataFrame, cells: int = CELLS, retry: tuple[int, ...] = RETRY,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, diff_edited, diff_next (recovered paragraphs)."""
    spark = docs.sparkSession
    at = scratch_path(spark, "versions")
    versions(docs, id_col, text_col).write.parquet(at)
    rows = spark.read.parquet(at)

    def gone(b: str) -> Column:
        first = peel(subtract([F.col(f"a{t}") for t in range(3)], [F.col(f"{b}{t}") for t in range(3)]), cells)
        return F.coalesce(first, *[peel(subtract(sketch(F.col("a"), c), sketch(F.col(b), c)), c) for c in retry])

    for v in ("a", "e", "x"):
        rows = rows.withColumns({f"{v}{t}": col for t, col in enumerate(sketch(F.col(v), cells))})
    at = scratch_path(spark, "sketches")
    rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "edited_sha256", "a", "e", "x",
                as_text([F.col(f"a{t}") for t in range(3)], cells).alias("fingerprint"),
                as_text([F.col(f"e{t}") for t in range(3)], cells).alias("edited_fingerprint"),
                gone("e").alias("gone_e"), gone("x").alias("gone_x")).write.parquet(at)
    done = spark.read.parquet(at)
    hard = (done.where("gone_e is null").select(F.struct("row", F.lit("e").alias("of")).alias("pair"), "a", F.col("e").alias("b"))
            .unionByName(done.where("gone_x is null").select(F.struct("row", F.lit("x").alias("of")).alias("pair"), "a", F.col("x").alias("b"))))
    late = (_peel_rows(hard).groupBy(F.col("pair.row").alias("row"))
            .agg(F.max(F.when(F.col("pair.of") == "e", F.col("gone"))).alias("late_e"),
                 F.max(F.when(F.col("pair.of") == "x", F.col("gone"))).alias("late_x")))
    diff = {v: F.coalesce(f"gone_{v}", f"late_{v}") for v in ("e", "x")}
    return done.join(late, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("e"), diff["e"]).alias("near_edited"),
        likeness(F.col("a"), F.col("x"), diff["x"]).alias("near_next"),
        diff["e"].alias("diff_edited"), diff["x"].alias("diff_next"))

"""Merkle manifest of a table, and its proofs by a recursive query.

Every row is a leaf: H (sha256, lowercase hex) of its columns, each ``-`` if
null, else its UTF-8 byte count, ``:`` and its value. Per source the leaves
ascend by id; while several nodes remain, every three consecutive ones become
H of their digests as hex text. What remains is the source's subroot; the
subroots, in the order of the sources (null first, UTF-8 bytewise), give the
root in the same way.

* **Order.** Leaf digests, not texts, are range-partitioned by (source, id,
  digest) and written with their place in the partition; the partitions' row
  counts (one per partition) give every leaf its global number. No window over
  a source, so a source with a third of all rows is spread like the others.
* **Nodes.** A node covers a run of consecutive leaves and is named by (its
  level, the first leaf's number), which gives its parent's name by arithmetic.
  Levels are built three at a time by grouping up to 27 neighbours; every
  node becomes a written row: name, digest, children's digests, the parent's
  name and the place under it.
* **Proofs.** A recursive query climbs from every leaf along the parent names.
  Each step meets the parent's row, gives out the siblings of that step and
  folds the (tampered) hash with them. Only the step's siblings travel, not all
  so far; one grouping by leaf at the end joins the steps in their order.
  A node near the root is the parent of very many climbing rows. The nodes that
  cover the most leaves (at most ``BROADCAST_NODES``, counted before) are
  therefore broadcast and climbed in a second recursive query; below them a
  parent meets a bounded number of rows (3 ** k leaves, about 1.5 n / 3 ** k
  nodes lie above it), and those joins are shuffled.

Nulls: a null id sorts first and its row is never tampered with; a null source
is a source of its own. Equal ids are ordered by digest; repeated rows are
leaves of their own with equal digests. Empty table: no rows. Columns other
than those of the leaf are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.session import forget, written

FANOUT = 3
#: most nodes whose rows (under 300 bytes each) are broadcast
BROADCAST_NODES = 10_000
#: levels built by one grouping
STRIDE = 3
#: a name is first leaf * 64 + level; levels of the tree over the subroots
#: start at 32 (3 ** 31 leaves of a source are more than a long can count here)
_LEVELS, _TOP = 64, 32
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H of the concatenated parts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(hash32: Column) -> Column:
    return F.lower(F.hex(hash32))


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def tampered_ids(id_col: Column) -> Column:
    """Rows whose text is tampered with: 2 divides the crc32 of the id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _depth(n: Column) -> Column:
    """Levels above n leaves: how many powers of the fanout lie below n."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT ** k) for k in range(_TOP)]), lambda p: p < n))


def _power(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(FANOUT ** k) for k in range(_TOP)]), level + 1)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``no``, their number from 0 in ``order`` (nulls first),
    without a window over the table. Rows that tie in all of ``order`` may
    change places; a seeded random key spreads very many of them."""
    spread = [F.col(c).asc_nulls_first() for c in order]
    part = F.shiftright("_at", 33).cast("int")
    dealt, _ = written(
        rows.withColumn("_tie", F.rand(13)).repartitionByRange(*spread, F.col("_tie"))
        .sortWithinPartitions(*spread).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", part), "numbered")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    return (dealt.join(F.broadcast(starts), "_part")
            .withColumn("no", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_at", "_start"))


def _named(level: Column, first: Column) -> Column:
    return first * _LEVELS + level


def _upward(level: Column, pos: Column, begin: Column, depth: Column, base: int) -> tuple[Column, Column]:
    """(parent's name, place under it) of the node at ``pos`` of ``level`` in
    a tree that begins at leaf ``begin``; null for the tree's own root."""
    up = _named(level + 1 + base, begin + F.floor(pos / FANOUT).cast("long") * _power(level + 1))
    inner = level < depth
    return F.when(inner, up).cast("long"), F.when(inner, pos % FANOUT).cast("int")


def _grown(nodes: Column, levels: Column) -> Column:
    """All nodes above up to 27 neighbouring ones (digest h, leaves w): an
    array of (level above them, place in that level, digest, leaves, children),
    ``levels`` levels of it."""
    def layer(below: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(below) / FANOUT).cast("int") - 1),
                           lambda i: F.slice(below, i * FANOUT + 1, F.lit(FANOUT)))
        return F.transform(runs, lambda run: F.struct(
            digest(F.array_join(F.transform(run, lambda x: text_of(x["h"])), "")).alias("h"),
            F.aggregate(run, F.lit(0).cast("long"), lambda n, x: n + x["w"]).alias("w"),
            F.transform(run, lambda x: x["h"]).alias("kids")))

    def placed(k: int):
        return lambda n, i: F.struct(F.lit(k).alias("k"), i.alias("i"), n["h"].alias("h"), n["w"].alias("w"),
                                     n["kids"].alias("kids"))

    out, below = [], nodes
    for k in range(1, STRIDE + 1):
        level = layer(below)
        out.append(F.when(levels >= k, F.transform(level, placed(k)))
            .otherwise(F.array().cast("array<struct<k:int,i:int,h:binary,w:bigint,kids:array<binary>>>")))
        below = F.transform(level, lambda n: F.struct(n["h"].alias("h"), n["w"].alias("w")))
    return F.concat(*out)


def build_levels(leaves: DataFrame, base: int, max_depth: int) -> list[tuple[DataFrame, str]]:
    """Node rows of all trees above ``leaves`` (tree, begin, depth, pos, h, w):
    tree, begin, depth, level, pos, h, w, kids; one written table (and its
    path) per three levels."""
    own, tables, wide = ["tree", "begin", "depth"], [], FANOUT ** STRIDE
    below = leaves.select(*own, "pos", "h", "w")
    for low in range(0, max_depth, STRIDE):
        groups = (below.where(F.col("depth") > low)
                  .groupBy(*own, F.floor(F.col("pos") / wide).cast("long").alias("block"))
                  .agg(F.array_sort(F.collect_list(F.struct("pos", "h", "w"))).alias("run")))
        across = F.element_at(F.array(*[F.lit(FANOUT ** (STRIDE - k)) for k in range(1, STRIDE + 1)]), F.col("n.k"))
        rows = groups.select(*own, "block", F.explode(_grown(F.col("run"), F.col("depth") - low)).alias("n")).select(
            *own, (F.col("n.k") + low).alias("level"), (F.col("block") * across + F.col("n.i")).alias("pos"), "n.h", "n.w", "n.kids")
        table, at = written(rows, f"merkle-{base}-{low}")
        tables.append((table, at))
        below = table.where(F.col("level") == low + STRIDE).select(*own, "pos", "h", "w")
    return tables


def _place(rows: DataFrame, level: Column, base: int, over: DataFrame | None) -> DataFrame:
    """``rows`` (tree, begin, depth, pos) with ``up`` and ``slot``. Only the
    trees' own roots look up their place in the tree above (``over``)."""
    if over is None:
        up, slot = _upward(level, F.col("pos"), F.col("begin"), F.col("depth"), base)
        return rows.withColumns({"up": up, "slot": slot})
    inner = rows.where(level < F.col("depth"))
    up, slot = _upward(level, F.col("pos"), F.col("begin"), F.col("depth"), base)
    return (inner.withColumns({"up": up, "slot": slot})
            .unionByName(rows.where(level >= F.col("depth")).join(over, "tree").select(*rows.columns, "up", "slot")))


_CLIMB = """
WITH RECURSIVE climb(no, up, slot, folded, sibs, sub, step) AS (
  SELECT no, up, slot, folded, CAST(NULL AS BINARY), CAST(NULL AS BINARY), step FROM _merkle_start
  UNION ALL
  SELECT no, n_up, n_slot, unhex(sha2(CAST(concat(l, lower(hex(folded)), r) AS BINARY), 256)),
         unhex(concat(l, r)), n_sub, step + 1
  FROM (SELECT /*+ {hint} */ c.no, c.folded, c.step, n.up AS n_up, n.slot AS n_slot, n.sub AS n_sub,
               array_join(transform(slice(n.kids, 1, c.slot), x -> lower(hex(x))), '') AS l,
               array_join(transform(slice(n.kids, c.slot + 2, {fanout}), x -> lower(hex(x))), '') AS r
        FROM climb c JOIN _merkle_nodes n ON c.up = n.id))
SELECT no, up, slot, folded, sibs, sub, step FROM climb WHERE sibs IS NOT NULL
"""


def _climbed(spark: SparkSession, start: DataFrame, nodes: DataFrame, hint: str) -> DataFrame:
    """The steps of the recursive climb from ``start`` along ``nodes``,
    written. The row limit of recursive queries is lifted for this one."""
    limit = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(limit, None)
    start.createOrReplaceTempView("_merkle_start")
    nodes.createOrReplaceTempView("_merkle_nodes")
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(_CLIMB.format(hint=hint, fanout=FANOUT)), "climb")[0]
    finally:
        spark.conf.set(limit, was) if was is not None else spark.conf.unset(limit)
        spark.catalog.dropTempView("_merkle_start")
        spark.catalog.dropTempView("_merkle_nodes")


def climb(start: DataFrame, nodes: DataFrame, room: int = BROADCAST_NODES) -> list[DataFrame]:
    """The steps of every row of ``start`` (no, up, slot, folded, step): first
    below the nodes that cover the most leaves, by shuffled joins, then among
    these, broadcast."""
    spark = start.sparkSession
    size = _depth(F.col("w"))  # one count per power of the fanout
    counts = {r["k"]: r["n"] for r in nodes.groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = max(counts) + 1
    while cut > 0 and sum(n for k, n in counts.items() if k >= cut - 1) <= room:
        cut -= 1
    columns = ["id", "up", "slot", "kids", "sub"]
    high, low = nodes.where(size >= cut).select(*columns), nodes.where(size < cut).select(*columns)
    state, steps = ["no", "up", "slot", "folded", "step"], []
    if any(k < cut for k in counts):
        steps.append(_climbed(spark, start, low, "SHUFFLE_HASH(n)"))
        start = start.select(*state).unionByName(steps[0].select(*state))
    if any(k >= cut for k in counts):
        over = start.join(F.broadcast(high.select(F.col("id").alias("up"))), "up", "left_semi")
        steps.append(_climbed(spark, written(over.select(*state), "climb-start")[0], high, "BROADCAST(n)"))
    return steps


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             columns: Sequence[str] = LEAF_COLUMNS, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and
    tampered (whether the folded leaf differs from the leaf)."""
    def leaf_of(text: Column) -> Column:
        return digest(*[field(text if c == text_col else F.col(c)) for c in columns])

    text = F.col(text_col).cast("string")
    cut = F.when(tampered_ids(F.col(id_col)), F.translate(text, "\n", "")).otherwise(text)
    spark = docs.sparkSession
    hashed, hashed_at = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    leaf_of(text).alias("h"), leaf_of(cut).alias("t")), "leaves")
    order, order_at = written(numbered(hashed, ["source", "doc_id", "h"]), "order")
    forget(spark, hashed_at)
    if not order.take(1):
        return _proofs(order.select("no", "doc_id", "h", "t", F.lit(0).alias("depth")), [], b"")
    # one row per source; its number is its place in the tree of the subroots
    sources, _ = written(order.groupBy("source").agg(F.min("no").alias("begin"), F.count(F.lit(1)).alias("n")), "sources")
    sources, _ = written(numbered(sources, ["source"]).select(
        F.col("source").alias("of"), F.col("no").alias("tree"), "begin", "n", _depth(F.col("n")).alias("depth")), "trees")
    tops = sources.agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest")).first()
    height = next(k for k in range(_TOP) if FANOUT ** k >= tops["n"])
    leaves, _ = written(order.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "no", "h", "t", "tree", "begin", "depth", (F.col("no") - F.col("begin")).alias("pos"),
        F.lit(1).cast("long").alias("w")), "placed")
    forget(spark, order_at)

    below = build_levels(leaves, 0, tops["deepest"])
    subroots = [t.where("level = depth").select("tree", "h") for t, _ in below]
    subroots.append(leaves.where("depth = 0").select("tree", "h"))
    top, _ = written(reduce(DataFrame.unionByName, subroots).join(sources.select("tree", "n"), "tree").select(
        F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("begin"), F.lit(height).alias("depth"),
        F.col("tree").alias("pos"), "h", F.col("n").alias("w")), "subroots")
    above = build_levels(top, _TOP, height)
    root = (above[-1][0].where("level = depth") if above else top).first()["h"]

    over = _place(top, F.lit(0), _TOP, None).select(F.col("pos").alias("tree"), "up", "slot")
    parts = []
    for tables, base, link in ((below, 0, over), (above, _TOP, None)):
        for t, _ in tables:
            sub = F.col("h") if link is not None else F.lit(None).cast("binary")
            first = F.col("begin") + F.col("pos") * _power(F.col("level"))
            parts.append(_place(t, F.col("level"), base, link).select(
                _named(F.col("level") + base, first).alias("id"), "up", "slot", "kids", "w",
                F.when(F.col("level") == F.col("depth"), sub).alias("sub")))
    start = _place(leaves, F.lit(0), 0, over).select(
        "no", "up", "slot", F.col("t").alias("folded"), F.lit(0).alias("step"))
    if not parts:
        return _proofs(leaves, [], bytes(root))
    nodes, _ = written(reduce(DataFrame.unionByName, parts), "nodes")
    forget(spark, *[at for _, at in (*below, *above)])
    return _proofs(leaves, climb(start, nodes, broadcast_nodes), bytes(root))


def _proofs(leaves: DataFrame, steps: list[DataFrame], root: bytes) -> DataFrame:
    """One row per leaf from its own row and its steps."""
    none = F.lit(None).cast("binary")
    rows = leaves.select("no", F.lit(0).alias("step"), none.alias("sibs"), none.alias("sub"), none.alias("end"),
                         "doc_id", "h", "t", "depth")
    for s in steps:  # only the fold at the root is kept
        end = F.when(F.col("up").isNull(), F.col("folded")).alias("end")
        rows = rows.unionByName(s.select("no", "step", "sibs", "sub", end), allowMissingColumns=True)
    got = rows.groupBy("no").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "h", "t", "depth", "sub", "end")],
        F.array_sort(F.collect_list(F.struct("step", "sibs"))).alias("path"))
    path = F.array_join(F.transform("path", lambda s: F.coalesce(text_of(s["sibs"]), F.lit(""))), "")
    whole, folded = F.lit(root.hex()), text_of(F.coalesce("end", "t"))
    return got.select(
        "doc_id", text_of(F.col("h")).alias("leaf"),
        text_of(F.when(F.col("depth") == 0, F.col("h")).otherwise(F.col("sub"))).alias("subroot"),
        whole.alias("root"), F.sha2(path.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"),
        (folded == whole).alias("verified"), (F.col("h") != F.col("t")).alias("tampered"))


#: DuckDB twin: levels and climbs as recursive queries, the checksum bit by bit
ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS k, doc_id, source,
    [CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
     CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
     CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
     CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END] AS head,
    text,
    CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(
      flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
        lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT),
      4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents),
hashed AS (
  SELECT k, doc_id, coalesce('s' || source, '') AS src,
    sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(array_to_string(head, '') || coalesce(strlen(cut) || ':' || cut, '-')) AS tampered
  FROM raw),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS pos,
    count(*) OVER (PARTITION BY src) AS n
  FROM hashed),
below AS (
  SELECT 0 AS lv, src, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lv + 1, src, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM below WHERE n > 1 GROUP BY lv, src, pos // 3),
subs AS (
  SELECT src, h, row_number() OVER (ORDER BY encode(src)) - 1 AS pos, count(*) OVER () AS n FROM below WHERE n = 1),
above AS (
  SELECT 0 AS lv, pos, h, n FROM subs
  UNION ALL
  SELECT lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM above WHERE n > 1 GROUP BY lv, pos // 3),
nodes AS (
  SELECT lv, 'in' || src AS tree, pos, h, n FROM below UNION ALL SELECT lv, 'over', pos, h, n FROM above),
sided AS (
  SELECT lv, tree, pos, n,
    coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h, 1) OVER w, '') AS l,
    coalesce(lead(h, 1) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS r
  FROM nodes WINDOW w AS (PARTITION BY tree, lv, pos // 3 ORDER BY pos)),
inner_climb AS (
  SELECT k, 0 AS lv, src, pos, tampered AS folded, '' AS proof, n FROM leaves
  UNION ALL
  SELECT c.k, c.lv + 1, c.src, c.pos // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r, (c.n + 2) // 3
  FROM inner_climb c JOIN sided s ON s.tree = 'in' || c.src AND s.lv = c.lv AND s.pos = c.pos WHERE c.n > 1),
outer_climb AS (
  SELECT c.k, 0 AS lv, c.src, subs.h AS subroot, subs.pos, c.folded, c.proof, subs.n
  FROM inner_climb c JOIN subs USING (src) WHERE c.n = 1
  UNION ALL
  SELECT c.k, c.lv + 1, c.src, c.subroot, c.pos // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r, (c.n + 2) // 3
  FROM outer_climb c JOIN sided s ON s.tree = 'over' AND s.lv = c.lv AND s.pos = c.pos WHERE c.n > 1),
root AS (SELECT h AS root FROM above WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified,
  leaf <> tampered AS tampered
FROM leaves JOIN outer_climb o USING (k) CROSS JOIN root WHERE o.n = 1
"""

"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit set where over half of its shingle hashes
have it set. Fingerprints that differ in at most ``radius`` bits are linked.

Two such fingerprints agree on at least one of ``radius + 1`` bit bands, so
each distinct fingerprint is dealt to one shard key per band; a key that
holds more than ``SPLIT`` fingerprints is dealt anew by bands of its remaining
bits, exactly and without dropping any. Every shard holds BK-trees, one per
key: a child hangs on the edge numbered by its Hamming distance to the parent.
A search follows only edges within the radius of the distance to the node.
The trees are broadcast when their measured size is at most
``BROADCAST_BYTES``; beyond that trees and queries meet by a shuffle on the
shard. A task gives back a spanning forest of the links that it found, never
all pairs, and star contraction joins the forests into components.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; repeated rows share a component; other columns are not read. A
component's id is its smallest doc_id, null ids apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.components import connected_components
from gridcast.llm.texts import map_texts
from gridcast.session import scratch_path

RADIUS = 2
SHINGLE = 3
SEED = 42
#: fingerprints under one key before it is dealt anew, and rounds of that
SPLIT = 2048
LEVELS = 3
#: fingerprints of a shard, about
SHARD = 8192
#: bytes of all trees up to which they are broadcast
BROADCAST_BYTES = 16 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def simhash(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n, ones, digest = len(words) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    join = b" ".join
    for at in range(0, n, _CHUNK):
        part = words[at:at + _CHUNK + width - 1]
        h = np.array([digest(join(w), seed) for w in zip(*(part[i:] for i in range(width)))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def work(texts: list[str]) -> list[list]:
        raw = np.array([simhash(t, width, seed) for t in texts], np.uint64)
        return [raw.view(np.int64)]

    return map_texts(docs, id_col, text_col, "fp long", work)


class Forest:
    """BK-trees, one per key, as flat arrays."""

    def __init__(self, fps: np.ndarray, edges: np.ndarray, nodes: np.ndarray, keys: np.ndarray, roots: np.ndarray):
        self.fps, self.edges, self.nodes, self.keys, self.roots = fps, edges, nodes, keys, roots

    @classmethod
    def build(cls, keys: np.ndarray, fps: np.ndarray) -> Forest:
        """All trees level by level: the first open fingerprint of a group
        becomes a node, the others go on to the edge of their distance."""
        order = np.lexsort((fps, keys))
        keys, fps = keys[order], fps[order]
        fresh = np.ones(len(fps), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
        keys, fps = keys[fresh], fps[fresh]
        edge = np.full(len(fps), -1, np.int64)  # parent * 65 + distance
        root_keys, roots = np.unique(keys, return_index=True)
        open_, group = np.arange(len(fps)), np.searchsorted(root_keys, keys)
        while len(open_):
            _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
            heads = open_[first]
            rest = np.ones(len(open_), bool)
            rest[first] = False
            open_, head = open_[rest], heads[inverse[rest]]
            group = head * 65 + np.bitwise_count(fps[open_] ^ fps[head]).astype(np.int64)
            edge[open_] = group
        hung = np.flatnonzero(edge >= 0)
        hung = hung[np.argsort(edge[hung], kind="stable")]
        return cls(fps, edge[hung], hung, root_keys, roots)

    def near(self, keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, nodes) within the radius, some at a time."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.zeros(0, np.int64)
        stack = [(known, self.roots[at[known]])] if len(known) else []
        while stack:
            query, node = stack.pop()
            if len(query) > _CHUNK:
                stack += [(query[:len(query) // 2], node[:len(query) // 2]),
                          (query[len(query) // 2:], node[len(query) // 2:])]
                continue
            far = np.bitwise_count(fps[query] ^ self.fps[node]).astype(np.int64)
            hit = far <= radius
            yield query[hit], node[hit]
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(far - radius, 0))
            hi = np.searchsorted(self.edges, node * 65 + np.minimum(far + radius, 64), side="right")
            n = hi - lo
            if n.any():
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                stack.append((np.repeat(query, n), self.nodes[np.repeat(lo, n) + step]))

    def to_bytes(self) -> list[bytes]:
        return [a.tobytes() for a in (self.fps, self.edges, self.nodes, self.keys, self.roots)]

    @classmethod
    def from_bytes(cls, parts) -> Forest:
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64)
        return cls(*(np.frombuffer(p, k) for p, k in zip(parts, kinds)))


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of the given pairs in a table of class minima."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def spanning_links(forest: Forest, keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links over the classes that the queries' hits connect."""
    names, code = np.unique(np.concatenate([forest.fps, fps]), return_inverse=True)
    of_node, of_query = code[:len(forest.fps)], code[len(forest.fps):]
    label = np.arange(len(names))
    for query, node in forest.near(keys, fps, radius):
        _hook(label, of_query[query], of_node[node])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[label[moved]].view(np.int64), names[moved].view(np.int64)


def _bands(free: int, parts: int) -> list[int]:
    """The set bits of a mask in ``parts`` masks of neighbouring bits."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[cut[i]:cut[i + 1]]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shard_keys(distinct: DataFrame, radius: int = RADIUS, split: int = SPLIT, levels: int = LEVELS) -> DataFrame:
    """(key, fp) such that fingerprints within the radius share a key; keys
    of a single fingerprint are left out, as nothing can be near it there."""
    spark = distinct.sparkSession
    masks = {i: m for i, m in enumerate(_bands((1 << 64) - 1, radius + 1))}
    dealt = distinct.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("path"))
    done = None
    for level in range(levels):
        table = F.create_map(*[x for p, m in masks.items() for x in (F.lit(p), F.lit(_signed(m)).cast("long"))])
        keyed = dealt.select("fp", "path", F.xxhash64("path", F.col("fp").bitwiseAND(table[F.col("path")])).alias("key"))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        at = scratch_path(spark, "keys")
        keyed.join(sizes, "key").write.parquet(at)
        kept = spark.read.parquet(at)
        last = level + 1 == levels
        ready = kept.where(F.col("n") <= split) if not last else kept
        done = ready.select("key", "fp") if done is None else done.unionByName(ready.select("key", "fp"))
        hot = kept.where(F.col("n") > split)
        if last or not hot.take(1):
            return done
        below = [(p, m | b) for p, m in masks.items()
                 for b in _bands(((1 << 64) - 1) & ~m, radius + 1)]
        first = max(masks) + 1
        children = F.create_map(*[x for p in masks for x in (F.lit(p), F.array(
            *[F.lit(first + i) for i, (q, _) in enumerate(below) if q == p]))])
        dealt = hot.select("fp", F.explode(children[F.col("path")]).alias("path"))
        masks = {first + i: m for i, (_, m) in enumerate(below)}
    return done


def near_links(distinct: DataFrame, radius: int = RADIUS, split: int = SPLIT, shard: int = SHARD,
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints that steps of at
    most ``radius`` bits connect. ``distinct`` has each fp once."""
    spark = distinct.sparkSession
    keys = shard_keys(distinct, radius, split)
    shards = max(1, -(-keys.count() // shard))
    rows = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    parts = "fps binary, edges binary, nodes binary, keys binary, roots binary"
    names = ["fps", "edges", "nodes", "keys", "roots"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Forest.build(pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64))
        return pd.DataFrame([[pdf["shard"].iloc[0], *tree.to_bytes()]], columns=["shard", *names])

    at = scratch_path(spark, "trees")
    rows.groupBy("shard").applyInPandas(build, f"shard long, {parts}").write.parquet(at)
    trees = spark.read.parquet(at)
    size = trees.agg(F.sum(sum(F.length(n) for n in names)).alias("size")).first()["size"] or 0
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r["shard"]: tuple(bytes(r[n]) for n in names) for r in trees.collect()})

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.argsort(own, kind="stable")
                ends = np.flatnonzero(np.diff(own[order])) + 1
                for some in np.split(order, ends):
                    if len(some):
                        forest = Forest.from_bytes(sent.value[int(own[some[0]])])
                        a, b = spanning_links(forest, key[some], fp[some].view(np.uint64), radius)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        return rows.select("shard", "key", "fp").mapInArrow(walk, "a long, b long")

    def meet(queries: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(tree):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        forest = Forest.from_bytes(tuple(tree[n].iloc[0] for n in names))
        a, b = spanning_links(forest, queries["key"].to_numpy(), queries["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy("shard").cogroup(trees.groupBy("shard")).applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, shard: int = SHARD,
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    spark = docs.sparkSession
    at = scratch_path(spark, "fingerprints")
    fingerprints(docs, width, seed, id_col, text_col).write.parquet(at)
    rows = spark.read.parquet(at)
    at = scratch_path(spark, "distinct")
    rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).write.parquet(at)
    distinct = spark.read.parquet(at)
    roots = connected_components(near_links(distinct.select("fp"), radius, split, shard, broadcast_bytes))
    at = scratch_path(spark, "members")
    roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "rep").write.parquet(at)
    members = spark.read.parquet(at)
    named = members.join(members.groupBy("root").agg(F.min("rep").alias("least")), "root").select("fp", "least")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What a row is told apart and ordered by: its id (nulls last), its text
    by SHA-256 (nulls last), a hash of its other columns."""
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col)
              and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                    F.col(text_col).isNull().alias("no_text"), F.unhex(F.sha2(text, 256)).alias("text"),
                    F.xxhash64(F.lit(0), *others).alias("rest"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, columns as they are: the first by
    ``row_key``, so ids may be null or stand on several texts. Only rows with
    the same key count as one."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # columns of any name stay apart from the key
    keyed = docs.select(row_key(docs, id_col, text_col).alias("row"), whole.alias("own"))
    small = keyed.select("row", F.col("own")[text_col].alias("text"))
    keep = near_duplicates(small, id_col="row", text_col="text", **options).select(
        F.col("component_id").alias("row")).distinct()
    # a key is never null as a whole, so the semi-join and the removal of repeated rows share one shuffle of the texts
    return keyed.join(keep, "row", "left_semi").dropDuplicates(["row"]).select("own.*")

"""Arrow helpers shared by the text operators.

Every text operator reads whole texts in Arrow batches, one row in and one
row out, so the work follows the scan's partitions and a lost task is simply
run again. A null text counts as the empty text.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: bytes of text that a worker holds as Python objects at once, about; a
#: longer text stands alone
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by the size of the texts in column ``at``, so that a
    worker's memory does not depend on how long the texts of a batch are."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def per_worker(key: tuple, make: Callable):
    """One object per Python worker process, kept from task to task.
    Functions arrive by value with each task, so their own globals do not
    last; a module entry of the process does."""
    kept = sys.modules.setdefault("_gridcast_worker", types.ModuleType("_gridcast_worker")).__dict__
    name = repr(key)
    if name not in kept:
        kept[name] = make()
    return kept[name]


def map_texts(docs: DataFrame, id_col: str, text_col: str, outputs: str,
              work: Callable[[list[str]], list]) -> DataFrame:
    """(id, outputs): ``work`` gets the texts of one batch and returns one
    list per output column. Other columns of ``docs`` are not read."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {outputs}"
    kinds = arrow_types(picked, outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = work(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, k) for c, (_, k) in zip(out, kinds)],
                ["doc_id"] + [n for n, _ in kinds])

    return picked.mapInArrow(run, schema)


def rewrite_texts(docs: DataFrame, text_col: str,
                  work: Callable[[list[str | None]], tuple[list | None, list | None]],
                  length_col: str | None = None) -> DataFrame:
    """``docs`` with the same columns: ``work`` gets a batch's texts and
    returns (new texts or None, kept flags or None). Rows whose flag is false
    go; ``length_col``, if the table has it, follows a changed text."""
    schema = docs.schema
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            old = batch.column(at).to_pylist()
            new, kept = work(old)
            arrays, names = list(batch.columns), batch.schema.names
            if new is not None:
                arrays[at] = pa.array(new, batch.column(at).type)
                if length_at is not None:
                    was = batch.column(length_at).to_pylist()
                    arrays[length_at] = pa.array(
                        [w if a == b else len(b) for a, b, w in zip(old, new, was)],
                        batch.column(length_at).type)
            out = pa.RecordBatch.from_arrays(arrays, names)
            yield out if kept is None else out.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)


def arrow_types(df: DataFrame, outputs: str) -> list[tuple[str, pa.DataType]]:
    known = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
             "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
             "array<bigint>": pa.list_(pa.int64())}
    pairs = [x.strip().rsplit(" ", 1) for x in outputs.split(",")]
    return [(n, known[k]) for n, k in pairs]


def digest_spans(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined, in the order given."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

"""Vectors in bounded shards of the shared folder, and queries against them in blocks.

A table of vectors is written once with a row number.  Rows are dealt to shards, and the
query rows to blocks, by a hash of that number: equal vectors, one label or one id that
hold a third of the rows are spread like all others.  Every shard and block is one file of
arrays; a search task reads one shard and one block at a time, whatever the table's size.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.store import load_bytes, new_folder, save_bytes, shuffle_partitions, written

#: pairs of a shard and a block that one task searches at most, one after the other
PAIRS = 64


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * component) of every component as a long."""
    return F.transform(doubles(vector), lambda x: F.floor(x * F.lit(float(factor))).cast("long"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written with a column ``row``, a number of its own for each."""
    return written(rows.withColumn("row", F.monotonically_increasing_id()), name)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix; shorter lists get zeros at their end."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(edges)
    if (sizes == dims).all():
        return flat[edges[0]:edges[-1]].reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), flat.dtype)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out[i, :b - a] = flat[a:b]
    return out


def save_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays."""
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    save_bytes(folder, f"{name}.npz", buf.getbuffer())


def load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(load_bytes(folder, f"{name}.npz"))) as z:
        return {k: z[k] for k in z.files}


def stored(rows: DataFrame, per_file: int | Callable[[int], int], make: Callable[[pa.Table], dict[str, np.ndarray]], name: str) -> tuple[str, int]:
    """Deal ``rows`` to files of about ``per_file`` rows (or as many as it says for the number of all) made by
    ``make``; the folder and how many files."""
    n = rows.count()
    files = -(-n // (per_file(n) if callable(per_file) else per_file))
    folder = new_folder(rows.sparkSession, name)
    if files:
        def save(group: pa.Table) -> pa.Table:
            part = group.column("part")[0].as_py()
            save_arrays(folder, str(part), make(group))
            return pa.table({"n": pa.array([group.num_rows], pa.int64())})

        dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(files)).cast("long"))
        dealt.groupBy("part").applyInArrow(save, "n long").agg(F.sum("n")).first()
    return folder, files


def searched(spark, shards: tuple[str, int], blocks: tuple[str, int],
             search: Callable[[dict, dict], pa.RecordBatch], schema: str) -> DataFrame:
    """``search(shard, block)`` of every shard and block, as rows of ``schema``."""
    (shard_folder, n_shards), (block_folder, n_blocks) = shards, blocks
    pairs = n_shards * n_blocks
    if not pairs:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, {}
        for batch in batches:
            for pair in batch.column("id").to_pylist():
                s, b = divmod(pair, n_blocks)
                if s != held:
                    held, shard = s, load_arrays(shard_folder, str(s))
                yield search(shard, load_arrays(block_folder, str(b)))

    tasks = min(pairs, max(shuffle_partitions(spark), -(-pairs // PAIRS)))
    return spark.range(0, pairs, 1, tasks).mapInArrow(run, schema)

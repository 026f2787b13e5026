"""Intermediate tables and arrays in the cluster's shared folder.

Everything written here goes below the folder named by ``spark.checkpoint.dir``:
a lost executor costs a recomputation of its own tasks only.
"""

from __future__ import annotations

import io
import os
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (nothing is created yet)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: rows of one Arrow batch on the way to Python: whole texts are large rows
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which Spark counts in rows (10,000 unless set)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts (one aggregated number)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(col))), F.lit(0)).alias("n")).first()["n"])


# -- arrays, used inside tasks ----------------------------------------------

def _local(folder: str) -> str | None:
    u = urlparse(folder)
    return u.path if u.scheme in ("", "file") else None


def save_bytes(folder: str, name: str, raw) -> None:
    """Write ``folder/name``; a repeated task replaces it by the same bytes."""
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(raw)
        os.replace(part, f"{local}/{name}")
        return
    from pyarrow import fs
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(raw)


def load_bytes(folder: str, name: str) -> bytes:
    local = _local(folder)
    if local is not None:
        with open(f"{local}/{name}", "rb") as f:
            return f.read()
    from pyarrow import fs
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        return f.read()


def save_array(folder: str, name: str, arr: np.ndarray) -> None:
    """Write ``folder/name.npy``."""
    buf = io.BytesIO()
    np.save(buf, arr)
    save_bytes(folder, f"{name}.npy", buf.getbuffer())


def open_array(folder: str, name: str) -> np.ndarray:
    """Memory-map ``folder/name.npy`` (read whole where the folder is no mounted file system)."""
    local = _local(folder)
    if local is not None:
        return np.load(f"{local}/{name}.npy", mmap_mode="r")
    return np.load(io.BytesIO(load_bytes(folder, f"{name}.npy")))


class Mapped:
    """Arrays of a folder, mapped when needed; the least recently used are let go beyond ``limit``,
    as every mapping holds a file descriptor."""

    def __init__(self, folder: str, limit: int = 64):
        self.folder, self.limit, self._open = folder, limit, {}

    def get(self, name: str) -> np.ndarray:
        arr = self._open.pop(name, None)
        if arr is None:
            arr = open_array(self.folder, name)
            while len(self._open) >= self.limit:
                del self._open[next(iter(self._open))]
        self._open[name] = arr
        return arr

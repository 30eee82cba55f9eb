"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table through Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder all executors share and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``; only in local mode, where none is set, is a temporary one made.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="nearfield-ckpt-"))
    return df.checkpoint(eager=True)


def crc_mod(doc_id, n: int):
    """crc32 of the id's decimal text, modulo ``n``; the split rule for held-out rows (null id: null)."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def small(df: DataFrame, row_bytes: int | Column, limit_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast of an already materialised ``df`` if the sum of ``row_bytes``, a number or a column, fits
    ``limit_bytes``; a larger one is returned as it is and joined by a shuffle."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= limit_bytes else df


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has fewer), picked by a hash of ``key``: a filter with a
    threshold from the counted rows, so no sort and nothing gathered; a rerun picks the same rows."""
    n = df.count()
    if n <= rows:
        return df
    steps = 1 << 30
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(steps)) < F.lit(int(rows / n * steps)))


def slices(batch, column: int, size: int = 1 << 20, rows: int = 1024):
    """Slices of an Arrow batch of at most ``rows`` rows and about ``size`` bytes in a text column; a longer text
    stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took

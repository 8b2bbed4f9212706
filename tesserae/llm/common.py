"""Helpers shared by the training-data operators."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.session import checkpoint, settle, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tesserae_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    fd, out = tempfile.mkstemp(prefix="tesserae-", suffix=".zip")  # Spark's file server hands it out
    os.close(fd)
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    sc._tesserae_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names for checkpoints, for written tables."""
    return f"{shared_folder(spark)}/tesserae-{name}-{uuid.uuid4().hex}"


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20):
    """Cut a batch into runs of rows whose text is about max_bytes (a single longer row stays whole)."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def kept_names(kept, own) -> list[str]:
    """Names of kept columns beside a result's own: one that clashes gets underscores until it is free."""
    taken, out = {c.lower() for c in own}, []
    for c in kept:
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        out.append(c)
    return out


def lower_ascii(col):
    """A-Z only; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

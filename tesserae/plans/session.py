"""Session helpers."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names; a machine's own temporary one only where the session runs on one machine."""
    sc, base = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="tesserae-ckpt-"))
    return (base or sc.getCheckpointDir()).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table in the session's checkpoint folder.

    For loops: a checkpoint goes on with the constraints and the estimated size of its plan, and as
    sizes of joins are products, planning some dozens of rounds takes longer than running them. A
    written table starts anew, with its true size.
    """
    path = f"{shared_folder(df.sparkSession)}/tesserae-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

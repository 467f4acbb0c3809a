"""Shared helpers of the training-data operators.

Every operator first narrows its input to the columns it needs, by position,
so further columns never clash with its own names (Spark resolves names
without regard to case). Intermediate tables go to the shared folder that
``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def column_index(df: DataFrame, name: str) -> int:
    """Position of ``name``: the exact spelling first, else any case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return i
    raise ValueError(f"no column {name} among {df.columns}")


def narrow(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """``narrow(df, id=("doc_id", "bigint"))``: just these columns, cast."""
    at = {out: column_index(df, name) for out, (name, _) in wanted.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[out]}").cast(kind).alias(out) for out, (_, kind) in wanted.items()])


def with_plain_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with columns ``c0, c1, ...`` and the names to give back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="netsift-llm-", dir=os.environ.get("NETSIFT_TEST_DIR"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def step_folder(spark: SparkSession) -> str:
    """A new folder for the step tables of one operator; ``clear`` it once the operator's result is stored elsewhere."""
    return f"{shared_root(spark)}/netsift-llm/steps-{uuid.uuid4().hex}"


def clear(spark: SparkSession, folder: str) -> None:
    """Replace the folder and all its tables by one table without rows."""
    spark.range(0).write.mode("overwrite").parquet(folder)


def stored(df: DataFrame, name: str, large: bool = False, by: str | None = None, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    ``folder``: where (see ``step_folder``); by itself it stays.
    ``by``: a column with few values that later steps filter on; it names the folders.
    ``large``: the step has shuffled much of the input. Its shuffle files are
    then of no use, and Spark deletes them once the driver's JVM has collected
    what refers to them; that is asked for here, after the moment that the
    finished query still waits in the listeners' queue.
    """
    spark = df.sparkSession
    path = f"{folder or shared_root(spark) + '/netsift-llm'}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    for _ in range(2 if large else 0):  # the first collection only frees what the shuffles hang on
        time.sleep(0.4)
        spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.schema(schema).parquet(path)

"""Session helpers: table access, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a context, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_lurescope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="lurescope-"), "lurescope.zip")
    with zipfile.ZipFile(path, "w") as made:
        for file in sorted(root.rglob("*.py")):
            made.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._lurescope_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary one; on a cluster that is an error, as machines share no such folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"lurescope-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *taken: str) -> str:
    """A column name like ``name`` that none of ``taken`` is, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def without_rows(df: DataFrame, gone: DataFrame, key: str, code: Column) -> DataFrame:
    """The rows of df whose (key, code) isn't in ``gone``, a table of just those two columns; null keys are equal to null keys.

    Both sides shuffle at every size, as what goes grows with df; the side with few rows has only keys and codes.
    """
    k, c = (fresh(n, *df.columns) for n in ("gone_key", "gone_code"))
    side = gone.toDF(k, c)
    return df.join(side, F.col(key).eqNullSafe(F.col(k)) & (code == F.col(c)), "left_anti")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count finds at most ``rows`` rows; else df, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shards(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """How many parts of about ``rows_each`` rows df has."""
    return max(least, -(-df.count() // rows_each))

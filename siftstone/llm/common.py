"""What the operators share: reading tables and the folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: ASCII letters are lower-cased by translation wherever the rule says A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch, where the session has not set another number: rows are whole texts here, and both the executor and
#: its Python worker hold a batch outside the heap.
BATCH_ROWS, SPARKS_OWN = "1000", "10000"


def ready(spark: SparkSession) -> SparkSession:
    """The package on the executors, and small batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == SPARKS_OWN:
        spark.conf.set(key, BATCH_ROWS)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; read by Spark, so that any store will do."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one is set here only where none is (local runs, tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it is now, kept in the checkpoint folder: lost executors don't lose it, and its lineage ends."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spare(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, whatever their letter case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_remainder(key: str, modulus: int) -> Column:
    """crc32 of an id's text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus

"""Sessions, table access and the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "foliant", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoint() at the folder the cluster names; choose one only where none is set (local tests)."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "_checkpoints")
    spark.sparkContext.setCheckpointDir(folder)


def stable_hash(*cols, seed: int = 0):
    """A 64-bit hash column, the same on every run and at every partitioning."""
    return F.xxhash64(F.lit(seed), *cols)


#: Rows and bytes up to which a side of a join is broadcast after both were counted.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20


def _bytes_of(df: DataFrame):
    """Bytes of a row: those of texts and nested values, eight for each other value."""
    size = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(df[field.name]), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(df[field.name]))), F.lit(0))
        else:
            size = size + 8
    return size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most so many rows and BROADCAST_BYTES, else as it is (the join then shuffles)."""
    first = df.limit(rows + 1)
    n, size = first.agg(F.count("*"), F.sum(_bytes_of(first))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder that holds this package on the path of Python workers, where it is there too (local mode, shared folders).

    On other clusters the package is installed on the workers or handed to spark-submit with --py-files.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, known) if x)


def spread(table: DataFrame) -> DataFrame:
    """A freshly read table in at least as many partitions as there are cores.

    A small file is one task however many cores wait; its rows are dealt out once, while tables of many files stay as they are read.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= min(cores, 8) else table.repartition(cores)


def bound_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Smaller Arrow batches than Spark's default, as a row holds a whole text; a setting made by the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, rows)

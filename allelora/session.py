"""Session helpers: building a session, reading tables, and the shared folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "allelora", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir`` or set on the context.

    Only a session on one machine (a local master) may name none: a temporary folder is set then. On a cluster that raises ValueError.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="allelora-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: later uses don't compute it again,
    and a lost executor doesn't lose it. Spark removes it with the frame if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str, codec: str = "zstd") -> DataFrame:
    """``cut`` as Parquet, which is smaller, lets later uses read single columns, and keeps plans of loops short; in folders by ``by``.

    It stays in the shared folder until ``clear_written``, or until the folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/written-{uuid4().hex}"
    df.write.options(**{"compression": codec, "parquet.compression.codec.zstd.level": "1"}).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.select(*[c for c in df.columns if c not in by], *by).schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Remove what ``written`` left in this session's shared folder. Frames that were made from it can't be used afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for one in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "written-*")):
        files.delete(one.getPath(), True)

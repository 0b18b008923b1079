"""Tables by name, and tables written once to the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_open: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("treeloom_scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, one of our own on a single machine (tests); on a
    cluster that is an error, since a local folder would be another one on every node."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if kept is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        kept = spark.sparkContext.getCheckpointDir()
    return kept.rstrip("/")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written once and read again: loops keep short plans, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/treeloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_saved_at"] = path
    if (mine := _open.get()) is not None:
        mine.append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that saved() writes inside are deleted at the end; what is to last has to be written by then."""
    mine: list[DataFrame] = []
    token = _open.set(mine)
    try:
        yield
    finally:
        _open.reset(token)
        forget(*mine)


def saved_counted(df: DataFrame, name: str, of: str = "true") -> tuple[DataFrame, int]:
    """saved(), and the number of rows (of those that a condition holds for), which is told by the same job."""
    seen = Observation()
    df_ = df.observe(seen, F.count_if(F.expr(of)).alias("n"))
    out = saved(df_, name)
    return out, seen.get["n"]


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that saved() wrote and that nothing reads any more: superseded rounds of a loop."""
    for t in tables:
        path = t.__dict__.get("_saved_at") if t is not None else None
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

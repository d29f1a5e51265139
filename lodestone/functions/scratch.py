"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their texts, of a table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where none is named, a local session takes one under the warehouse; a cluster's session is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lodestone-checkpoints"
    return named.rstrip("/")


def keep(df: DataFrame, name: str = "table", *folders: str) -> DataFrame:
    """df written to the shared folder and read back: a lost executor costs no earlier stage. ``folders``: columns by whose values the rows lie in folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def sent(df: DataFrame, *texts: str) -> DataFrame:
    """A kept df, to be broadcast if it is counted to be small: BROADCAST_ROWS, and BROADCAST_BYTES of texts (columns), at most."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in texts), F.lit(0)).cast("long")
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _delete(path: str) -> None:
    spark = _written.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*kept: DataFrame) -> None:
    """Deletes what keep() wrote, once all that is read from it is itself kept."""
    for df in kept:
        if (path := getattr(df, "kept_at", None)) in _written:
            _delete(path)


def drop_kept() -> None:
    """Deletes what keep() wrote and is still there; runs by itself when the driver ends."""
    while _written:
        try:
            _delete(next(iter(_written)))
        except Exception:  # noqa: BLE001  the JVM may be gone already; then the folder's owner cleans up
            return


atexit.register(drop_kept)

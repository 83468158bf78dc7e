"""Session defaults and the helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session defaults. On a cluster the submitter's settings win: nothing here is set where a value exists.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    # What an operator wrote to cut its lineage goes once nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "marlspike", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with UTC, AQE and Arrow on; ``conf`` overrides by dotted key."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project tables as a DataFrame; the scan stays lazy, so pruning and pushdown reach it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``; a temporary one only in a single process.

    Other machines can't read a local folder, so a cluster that names no shared one is an error.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marlspike-", dir=os.environ.get("TMPDIR"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, so later jobs neither recompute nor lose them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` if it is proven to hold at most ``max_rows`` rows; otherwise leave the join to the optimiser."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The newest row of each key: highest ``order``, ties broken by the largest payload.

    Runs as one ``max_by`` aggregation, so versions of a hot key are merged before the shuffle. Rows with a
    null key form one group per null pattern; a null ``order`` value loses against any other. Maps can't be
    compared, so ties between them are broken by their hash.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    has_map = [c for c in rest if "map<" in dict(df.dtypes)[c]]
    if not has_map:
        top = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r")))
        return df.groupBy(*keys).agg(top.alias("_row")).select(*keys, *(F.col(f"_row.r.{c}").alias(c) for c in rest))
    plain = [c for c in rest if c not in has_map]
    tie = F.xxhash64(*(F.to_json(F.struct(c)) for c in has_map))
    rank = F.struct(*order, *(F.struct(*plain),) * bool(plain), tie)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))

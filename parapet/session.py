"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Call sites are looked up for every Column otherwise, which slows down building plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "parapet", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    """A session with the engine's defaults; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the warehouse folder serves, which a cluster keeps on shared storage.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return posixpath.join(root, name)

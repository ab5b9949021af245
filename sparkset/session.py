"""Sessions and settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

PREFIX = "spark.sparkset."
#: Settings and their defaults.
DEFAULTS = {"cache.enabled": "false", "cache.dir": os.path.expanduser("~/.cache/sparkset"), "offline": "false"}


def build_session(app: str = "sparkset", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; further settings by name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=base | conf).getOrCreate()


def get(spark: SparkSession, key: str) -> str:
    return spark.conf.get(PREFIX + key, DEFAULTS[key])


def caching_enabled(spark: SparkSession) -> bool:
    return get(spark, "cache.enabled") == "true" and not offline_mode(spark)


def offline_mode(spark: SparkSession) -> bool:
    return get(spark, "offline") == "true"


def cache_dir(spark: SparkSession) -> str:
    return get(spark, "cache.dir")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` or the context names it; a temporary one only where all run on one machine."""
    context = spark.sparkContext
    option = context._jsc.sc().getCheckpointDir()
    found = context.getConf().get("spark.checkpoint.dir") or (option.get() if option.isDefined() else None)
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sparkset-")
    context.setCheckpointDir(made)
    return made

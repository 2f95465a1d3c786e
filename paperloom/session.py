"""Session factory: adaptive execution, UTC, ANSI."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with our defaults; ``conf`` (with __ for dots) goes over them. Cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName("paperloom")
    if master:
        builder = builder.master(master)
    cores = os.environ.get("BENCH_CPUS", "8")
    for k, v in (DEFAULTS | ({"spark.sql.shuffle.partitions": cores} if master else {})).items():
        builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()

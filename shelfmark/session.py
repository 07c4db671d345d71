"""Spark session construction with the settings every plan relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; ``conf`` overrides any setting.

    No master is set unless asked for, so that spark-submit decides on a cluster.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()

"""Session helper for local runs; on a cluster bring your own session and call :func:`tune`."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the relational plans profit from: joins on (doc_id, elem_id) reuse a partitioning by doc_id alone.
SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def local_session(name: str = "markloom", cpus: int | str = 8, memory: str = "12g", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    base = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()

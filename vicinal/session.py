"""Session settings the plans rely on; cluster settings win where they are set."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local-mode session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("vicinal")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        # Small inputs still fan out into costly pairs; keep all threads busy on them.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

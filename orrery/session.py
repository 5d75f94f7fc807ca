"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the test-suite and the benchmark rely on."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("orrery")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Without one a local session, all of whose
    tasks see this machine's disk, gets a temporary folder, and a cluster an error."""
    sc = spark.sparkContext
    if (now := sc.getCheckpointDir()) is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named:
            import re
            import tempfile

            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")

            named = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        sc.setCheckpointDir(named)
        now = sc.getCheckpointDir()
    return now


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that iterations don't grow the plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

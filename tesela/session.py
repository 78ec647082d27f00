"""Session helpers shared by operators and queries."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", partitions: str = "8") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tesela")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if spark.sparkContext.master.startswith(("local[", "local")) and not spark.sparkContext.master.startswith("local-cluster"):
            named = spark.sparkContext._jsc.sc().getCheckpointDir()
            named = named.get() if named.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), "tesela-checkpoints")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder: one job, and it survives lost executors."""
    return stage_table(df, "cut")


def _staged(spark: SparkSession) -> str:
    """Folder of the tables that this application has staged."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: columnar, so later scans prune columns.

    Results that are still to be read depend on it, so it stays until clear_staged() or the end of the application.
    """
    spark = df.sparkSession
    path = f"{_staged(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def clear_staged(spark: SparkSession) -> bool:
    """Delete all tables that this application has staged; whether there were any. For use once its results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_staged(spark))
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_rows_over(df: DataFrame, bound: int) -> bool:
    """True if df has more than bound rows; reads no more than it needs."""
    return df.limit(bound + 1).count() > bound


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed; once per application."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tesela-")) / "tesela.zip"  # on the driver; Spark serves it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)

"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_FOLDERS: dict = {}
_SHIPPED: set = set()


def build_session(app: str = "mailveil", master: str | None = None,
                  shuffle_partitions: int | None = None, quiet: bool = False) -> SparkSession:
    """A session with adaptive execution on; sizes stay with the cluster unless given."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", "12g"))
    if quiet:
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder stages are written to: the one the cluster names in its settings.

    A local folder is made only when the session names none and runs in local mode.
    """
    context = spark.sparkContext
    folder = (spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
              or context.getCheckpointDir())
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    if context not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context] = tempfile.mkdtemp(prefix="mailveil-stage-")
    return _LOCAL_FOLDERS[context]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a stage as a table in the shared folder and read it back.

    Later steps read only the columns they need, and a lost executor restarts from the
    table instead of the scan below it.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_rows(df: DataFrame) -> DataFrame:
    """A stage that grows with the input: its joins deal rows by key and never send them through the driver.

    Catalyst takes a file's size for that of its rows, so rows that compress well would be broadcast whole, 33 MB at least for each join.
    """
    return cut_lineage(df).hint("merge")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they need no install of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)

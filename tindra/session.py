"""Session set-up and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session has none of its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "tindra", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session to the operators."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", spark.sparkContext.master)
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the checkpoint folder of the context, else the one named by ``spark.checkpoint.dir``.

    Where both are unset a temporary folder is taken, which is right only for a local
    session; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tindra-checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a frame that reads it, so that it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, but as a compressed columnar table: later readers read only their columns.

    ``release`` deletes the table once nothing is read from it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored``."""
    for table in tables:
        if path := getattr(table, "_stored_at", None):
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
            table._stored_at = None


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per Spark context."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_tindra_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tindra-package-"), "tindra.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tindra_shipped = True

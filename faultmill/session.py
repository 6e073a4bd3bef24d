"""Session settings and shared-storage helpers."""

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # all instants are UTC; adaptive execution re-plans joins and splits skewed partitions
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # incident state never expires: it lives on local disk with changes in the checkpoint, not in the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # of a repeated JSON key the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def local_session(cores: int | str = 8, app: str = "faultmill", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on (time zone) to a session made elsewhere."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: ``spark.checkpoint.dir`` as the session names it.

    Where it is unset the session gets one beside its tables, in the warehouse, which all executors
    share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/faultmill/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return f"{folder}/data"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back.

    Used where a costly per-log stage feeds several branches: the text work runs once, its lineage
    ends at files that outlive any executor, and every reader prunes columns.  The files go when
    the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` early, once what was made of it is stored itself.

    Files of any other table stay.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/faultmill/".split(":")[-1].lstrip("/")
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if own not in folder:
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers, wherever the driver imported it from; once per application."""
    context = spark.sparkContext
    if getattr(context, "_faultmill_shipped", False):
        return
    root = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, module.relative_to(root.parent))
    folder = scratch_path(spark, "package")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/faultmill.zip")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(str(target.toString()))
    context._faultmill_shipped = True

"""Session settings, the shared scratch folder and the row limits that drive physical choices."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest ordered group (rows of one key) that a plain window may hold in one task.
GROUP_ROWS = "spark.segflow.groupRows"
#: Largest table (rows) that may be broadcast when its size is not bounded by construction.
BROADCAST_ROWS = "spark.segflow.broadcastRows"
#: The same in estimated bytes.
BROADCAST_BYTES = "spark.segflow.broadcastBytes"

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | str = "*", app: str = "segflow", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS, "2000000"))


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS, "1000000"))


def shared_folder(spark: SparkSession) -> str:
    """Root of the shared scratch space: the cluster's checkpoint folder.

    Only where a local session names none (tests) a temporary folder is made; on a cluster executors could not read it.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="segflow-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/segflow-{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Needed where a column depends on the physical partition of a row, which
    must not change when an executor is lost and a stage runs again.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to Parquet files below the shared folder, which take a fraction of a checkpoint's space, and read them."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(column: Column, kind: T.DataType) -> Column:
    """Estimated bytes of one value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            each = F.transform(column, lambda v: _width(v, inner))
            return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, v: a + v), F.lit(0).cast("long"))
        return F.greatest(F.size(column), F.lit(0)).cast("long") * 8
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    if isinstance(kind, T.MapType):
        return F.octet_length(F.to_json(column)).cast("long")
    return F.lit(16).cast("long")


def small_enough(df: DataFrame) -> bool:
    """True when ``df`` may be broadcast: both its rows and its bytes are within the limits."""
    spark = df.sparkSession
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
    if size["rows"] > broadcast_limit(spark):
        return False
    return (size["bytes"] or 0) <= int(spark.conf.get(BROADCAST_BYTES, str(128 << 20)))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per session, wherever the driver was started."""
    import hashlib
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_segflow_shipped", False):
        return
    package = Path(__file__).resolve().parent
    sources = sorted(package.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:12]
    archive = Path(tempfile.mkdtemp(prefix="segflow-")) / f"segflow-{digest}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sources:
            out.write(path, str(Path("segflow") / path.relative_to(package)))
    context.addPyFile(str(archive))
    context._segflow_shipped = True

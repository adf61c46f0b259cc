"""Session helpers: settings, table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quirel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for (AQE on, UTC, Arrow batches of bounded size)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for stages that cost much by row: where a table has fewer splits than the session has cores its
    rows (only the columns selected) are dealt out evenly; any larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir if set; in local mode a temporary folder is made once.

    On a cluster without the setting this raises, as a machine-local folder would be lost with its machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="quirel-")
    atexit.register(shutil.rmtree, d, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{d}")
    return f"file://{d}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, on durable storage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing still to be computed reads (each step of an iteration, for one)."""
    for df in tables:
        path = getattr(df, "cut_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, unless PYTHONPATH already does: a zip that the driver serves, once an application."""
    import io
    import os
    import sys
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or str(root.parent) in known or "site-packages" in root.parts:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(str(p.relative_to(root.parent)), p.read_bytes())
    path = Path(tempfile.mkdtemp(prefix="quirel-zip-")) / "quirel.zip"
    path.write_bytes(buf.getvalue())
    atexit.register(shutil.rmtree, path.parent, True)
    before = list(sys.path)
    spark.sparkContext.addPyFile(str(path))
    sys.path[:] = before  # the driver keeps its own copy
    _shipped.add(app)

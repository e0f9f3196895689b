"""Session helpers: test/bench session and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured like the tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkrec")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARKREC_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Where it is unset a scratch folder is made in local mode only; on a
    cluster that is an error, as executors do not see each other's folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="sparkrec-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkrec`` importable in the Python workers of any cluster: the
    package is zipped in memory, written once (content-addressed) into the
    shared ``spark.checkpoint.dir`` and added with ``SparkContext.addPyFile``.
    Idempotent per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkrec_shipped", False):
        return
    import hashlib
    import io
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in sorted(os.walk(pkg)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    info = zipfile.ZipInfo(os.path.relpath(full, os.path.dirname(pkg)), (1980, 1, 1, 0, 0, 0))
                    with open(full, "rb") as fh:
                        z.writestr(info, fh.read())
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:16]
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sparkrec-pkg/{digest}/sparkrec.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(target)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        out = fs.create(hpath, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(target)
    sc._sparkrec_shipped = True

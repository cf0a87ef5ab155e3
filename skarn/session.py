"""Sessions, and sending the package to executors that do not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def session(app: str = "skarn", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use "__" for "."."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


#: Bytes of rows that go to a Python worker at once, where the application sets no other. Spark's own bound of 64 MB, held
#: several times on both sides, is a large part of a small executor.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors through Spark and bounds the batches for Python workers, once for each
    application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        if not sc.getConf().contains(BATCH[0]):
            spark.conf.set(*BATCH)
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="skarn-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "skarn_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark

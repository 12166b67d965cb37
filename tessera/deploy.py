"""Sends this package to the executors of a session that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: A worker holds two Arrow batches at a time; Spark's 64 MB (or 10,000 rows) each would be most of what it needs.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Add the package as a Python file to the application, once; where the session sets no size of Arrow batches, set a small one."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, f"{_BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)

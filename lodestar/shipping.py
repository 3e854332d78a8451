"""Making this package importable in the executors' Python workers."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from lodestar.storage import shared_path

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def _archive() -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(ROOT, "lodestar")):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, ROOT))
    return held.getvalue()


def shipped(spark: SparkSession) -> SparkSession:
    """The session, its workers able to import this package.

    Where executors run on this machine the package's folder joins their Python path. On a
    cluster the package also goes through the shared folder as an archive.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
        if not sc.master.startswith("local"):
            jvm = sc._jvm
            path = jvm.org.apache.hadoop.fs.Path(shared_path(spark, "package") + ".zip")
            out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
            out.write(bytearray(_archive()))
            out.close()
            sc.addPyFile(path.toString())
        _SHIPPED.add(sc.applicationId)
    return spark

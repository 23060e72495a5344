"""Python workers must be able to import this package wherever the session was started."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SHIPPED: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ship_package(spark: SparkSession) -> None:
    """Sends the package's sources to the workers, once per application; not needed in local mode if PYTHONPATH, which the workers inherit, names their folder."""
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if (is_local(spark) and ROOT in on_path) or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="castgraph-code-")  # the driver's own copy, which Spark hands to the executors
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "castgraph_code"), "zip", ROOT, "castgraph"))

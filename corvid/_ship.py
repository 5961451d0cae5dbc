"""Makes this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application.

    Workers that have the package on their own path, and those that don't,
    then run the same code. Spark serves the archive; no shared folder is
    needed. Arrow batches, by default of 64 MB, become 4 MB, so that batches of
    long texts take little of an executor's memory; another setting stays.
    """
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, "4m")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="corvid-")) / "corvid_sources.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, f"{root.name}/{source.relative_to(root)}")
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark

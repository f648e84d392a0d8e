"""Sessions, and the package's way to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
#: Bytes of an Arrow batch, about. Spark counts to 10,000 rows otherwise, however long the texts are.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def build(name: str = "scriptloom", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use; on a cluster, use the session you are given."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.driver.memory": "8g", _BATCH: str(BATCH_BYTES),
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, unless their PYTHONPATH already has it, once for each application; and
    bounds the session's Arrow batches by bytes, unless it has a limit of its own."""
    context = spark.sparkContext
    if not spark.conf.getAll.get(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-package-")) / "scriptloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "scriptloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(path))

"""Sessions: settings that the operators rely on, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` are further settings with _ for the dots."""
    builder = SparkSession.builder.master(master).appName("tallyforge").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_has_tallyforge", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tallyforge-")) / "tallyforge.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(to))
    context._has_tallyforge = True

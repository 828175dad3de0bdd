"""The package itself, given to the executors: Python workers import it from there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(name))
    sc._lodestone_shipped = True

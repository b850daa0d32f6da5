"""Makes the package importable on executors, as --py-files would."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the application, once."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent.parent
    target = Path(tempfile.mkdtemp(prefix="kinfold-zip-")) / "kinfold_package.zip"
    with zipfile.ZipFile(target, "w") as held:
        for path in sorted([*root.joinpath("kinfold").rglob("*.py"), *root.glob("corpus_pipeline.py")]):
            held.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shipped(query):
    """The query, with the package shipped before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run

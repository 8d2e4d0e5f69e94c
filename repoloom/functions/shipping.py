"""The package for Python workers."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever they run; once per application.

    Like `--py-files`, for sessions that were started without it.  The archive is read on the
    driver only, which hands it out.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="repoloom-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as code:
        for file in sorted(package.rglob("*.py")):
            code.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)

"""Making the package known to a session's executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession, *modules: str) -> None:
    """Send this package, and ``modules`` beside it, to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in [*sorted((root / "spanweave").rglob("*.py")), *(root / m for m in modules)]:
            if p.exists():
                z.write(p, p.relative_to(root))
    path = Path(tempfile.mkdtemp(prefix="spanweave-")) / "spanweave.zip"
    path.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)

"""Session factory used by tests, the benchmark and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings every plan here assumes (UTC, AQE, Arrow)."""
    os.environ.setdefault("PYTHONHASHSEED", "0")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that their Python workers can import it
    wherever they run; the driver's file server hands it out."""
    import io
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package, raw = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    target = Path(tempfile.mkdtemp(prefix="strandline")) / "strandline_package.zip"
    target.write_bytes(raw.getvalue())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)

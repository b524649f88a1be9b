"""Sessions: settings that the engine relies on, and the package on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Merging at run time, and a calendar that does not depend on the machine.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", **settings: str) -> SparkSession:
    """A session on this machine, for tests and benches."""
    conf = SETTINGS | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | settings
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


#: Bytes of an Arrow batch between the JVM and Python; by rows alone, batches of long texts are large on both sides.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session (their Python need not have it installed), and bound Arrow batches."""
    sc = spark.sparkContext
    if int(spark.conf.get(BATCH[0], str(2**31 - 1))) == 2**31 - 1:  # not set by the session's owner
        spark.conf.set(BATCH[0], str(BATCH[1]))
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(made))
    sc._tidemark_shipped = True

"""Storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder.

    Where the session names none, and runs on one machine, a local folder is set;
    on a cluster that is an error, since no other machine would see such a folder.
    """
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None) or (context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = found or "file://" + tempfile.mkdtemp(prefix="quire-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows reads it
    as often as it likes, and the loss of an executor costs no rerun."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their
    Python workers can import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quire-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)

"""What the operators share: scans, shared storage, text splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .local_files import write_options

#: ASCII white space, the separators of words in all contracts of this folder.
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, and runs on one machine, a local folder is set;
    on a cluster that is an error, since no other machine would see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Any executor can read the table again, so the loss of one costs no rerun. The
    write's shuffle files are deleted with it: nothing else reads them, and Spark
    would keep them until the driver happens to collect its garbage.
    """
    conf, path = df.sparkSession.conf, shared_path(df.sparkSession, name)
    usual = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.options(**write_options(df.sparkSession, path)).parquet(path)
    finally:
        conf.set(SHUFFLES_GO, usual)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` made and that nothing reads any more: what was
    made from them has to be written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(t))
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cut_and_release(df: DataFrame, name: str, *broadcasts) -> DataFrame:
    """``cut``, after which what was broadcast for ``df`` is given back everywhere."""
    out = cut(df, name)
    for b in broadcasts:
        b.destroy()
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; the fast path holds for pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased (bytes.lower touches ASCII alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


_HELD: dict[str, list[Callable[[], None]]] = {}
_USED = ""


def holds_memory(group: str, clear: Callable[[], None]) -> None:
    """Say how to empty what a group of operators keeps in a Python worker."""
    _HELD.setdefault(group, []).append(clear)


def use_memory(group: str) -> None:
    """To be called where an operator's function starts in a worker: workers are
    used again by other operators, and what those have kept is let go and given
    back to the system."""
    global _USED
    if group == _USED:
        return
    _USED = group
    for other, clears in _HELD.items():
        if other != group:
            for clear in clears:
                clear()
    give_back()


def trimmed(run):
    """For functions over batches that keep nothing: free memory returns to the
    system at the end of a task, without a search for garbage."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def worker(group: str, keep: bool = False):
    """For functions over batches in a Python worker: use ``group``'s memory and,
    unless it is to be kept for the next task, give it back at the end."""

    def around(run):
        def inner(batches):
            use_memory(group)
            try:
                yield from run(batches)
            finally:
                if not keep:
                    for clear in _HELD.get(group, ()):
                        clear()
                    give_back()

        return inner

    return around


def give_back() -> None:
    """Garbage too, and then all free memory, returns to the system."""
    gc.collect()
    release()


def release() -> None:
    """Free memory of Arrow and of the C library returns to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_SHIPPED: set[str] = set()


#: Rows and bytes of an Arrow batch, in place of Spark's 10,000 and 64 MB: a
#: batch is held by the JVM and by Python at once, twice for each core.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def ship(spark: SparkSession, small_batches: bool = True) -> None:
    """Send this package to the executors, once per application, so that their
    Python workers can import it wherever the driver was started; keep Arrow
    batches small unless the session has chosen their size. ``small_batches``
    False bounds only their bytes, for tables of many narrow rows."""
    for key, (usual, small) in BATCH.items():
        if (small_batches or key.endswith("BytesPerBatch")) and spark.conf.get(key) == usual:
            spark.conf.set(key, small)
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

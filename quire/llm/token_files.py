"""Token files: flat unsigned integers with 64-bit document offsets.

A folder in shared storage holds, for each shard of a range partitioning by id,
files that begin with its name,
  .bin   the ids of its documents, one after another, little-endian unsigned
         16-bit integers (32-bit for vocabularies over 65,536);
  .idx   64-bit offsets, one more than documents: document d of the shard is at
         ids [idx[d], idx[d + 1]);
  .doc   64-bit document ids (documents with a null id come first; the manifest
         has their number);
and manifest.json, one entry per shard with its name, documents, ids and base, the
number of ids in all shards before it, which is a prefix sum over shard totals.
A task writes under a name of its own and the manifest names those of the tasks
that counted, so what lost, repeated or speculative tasks leave is never read and
nothing is ever renamed or overwritten.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder

#: Documents in a batch of rows read back, and bytes of their ids read at once
#: where a file cannot be mapped (more where one document has more).
ROWS, READ = 4096, 32 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class _Numbers:
    """A file of numbers: mapped where it is local, read by ranges otherwise."""

    def __init__(self, system, path: str, dtype: str):
        from pyarrow import fs

        self.dtype, self.mapped, self.file = np.dtype(dtype), None, None
        self.size = system.get_file_info(path).size // self.dtype.itemsize
        if isinstance(system, fs.LocalFileSystem):
            self.mapped = np.memmap(path, dtype=dtype, mode="r") if self.size else np.zeros(0, dtype)
        else:
            self.file = system.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return np.asarray(self.mapped[part])
        self.file.seek(part.start * self.dtype.itemsize)
        return np.frombuffer(self.file.read((part.stop - part.start) * self.dtype.itemsize), dtype=self.dtype)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode and write all documents in ascending id order; the manifest.

    Nulls: a null text is empty (its end id alone), null ids come first. Rows
    that repeat an id follow one another by text. An empty table gives a
    manifest without shards. Other columns are ignored. Texts move once, to
    their range of ids; the driver gets four numbers per shard.
    """
    import pyarrow as pa

    system, root = _fs(path)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator) -> Iterator:
        system, root = _fs(path)
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        context = TaskContext.get()
        shard = context.partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        own = f"{root}/{name}"
        ends, ids, n_null, at = [0], [], 0, 0
        with system.open_output_stream(f"{own}.bin") as out:
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                    tokens = enc.packed(text.as_py() or "") + end
                    out.write(tokens)
                    at += len(tokens) // len(end)
                    ends.append(at)
                    ids.append(i or 0)
                    n_null += i is None
        for kind, values in (("idx", ends), ("doc", ids)):
            with system.open_output_stream(f"{own}.{kind}") as out:
                out.write(np.array(values, dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (shard, len(ids), n_null, at))], names=["name", "shard", "n_docs", "n_null", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    found = sorted((r for r in rows.mapInArrow(run, "name string, shard long, n_docs long, n_null long, n_tokens long").collect() if r["n_docs"]), key=lambda r: r["shard"])
    manifest, base = [], 0
    for r in found:
        manifest.append(r.asDict() | {"base": base, "dtype": encoder(vocabulary).dtype})
        base += r["n_tokens"]
    with system.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> list[dict]:
    system, root = _fs(path)
    with system.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document, from the mapped files: id_col, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) and, if asked for, ids."""
    import pyarrow as pa

    manifest = read_manifest(path)
    kinds = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator) -> Iterator:
        system, root = _fs(path)
        for b in batches:
            for k in b.column(0).to_pylist():
                m = manifest[k]
                ids, ends, docs = (_Numbers(system, f"{root}/{m['name']}.{kind}", dtype) for kind, dtype in (("bin", m["dtype"]), ("idx", "<i8"), ("doc", "<i8")))
                first = 0
                while first < docs.size:
                    at = ends[slice(first, min(first + ROWS, docs.size) + 1)]
                    last = first + max(1, int(np.searchsorted(at, at[0] + READ // ids.dtype.itemsize, side="right")) - 1)
                    last = min(last, docs.size, first + ROWS)
                    at = at[: last - first + 1]
                    part = ids[slice(int(at[0]), int(at[-1]))].astype("<u4")
                    each = [part[a:z] for a, z in zip(at[:-1] - at[0], at[1:] - at[0])]
                    columns = [pa.array(docs[slice(first, last)], pa.int64(), mask=np.arange(first, last) < m["n_null"]), pa.array(at[:-1] + m["base"], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    first = last

    n = len(manifest)
    shards = spark.range(0, n, 1, n) if n else spark.range(0)
    return shards.mapInArrow(run, kinds)

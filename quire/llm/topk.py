"""Exact top-k by inner product over a bit-sliced index.

Components become integers floor(scale * x). A block of rows, in ascending id
order, keeps one bitmap per dimension and bit; the index of each block is made
once and stored. A query's score is a sum of those bitmaps, each weighted by a
power of two for each bit of the query's component; carry-save adders over whole
bitmaps turn the sum into the slices of all scores of the block at once. From the
most significant slice downward, rows with the bit set are taken as long as they
are at most k; rows still tied at the end are resolved exactly, by smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block and queries of a group: what one task holds. A block's stored
#: index is copied once for every group of queries.
BLOCK, GROUP = 16384, 4096
#: Larger integers leave the bitmaps for Python's integers.
WIDE = 1 << 20
#: Scores beyond these do not fit a long; they rank exactly and are shown as these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Index:
    """The bitmaps of one block."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        """``slices`` by dimension, bit and word."""
        self.ids, self.low, self.bits, self.words = ids, low, bits, slices.shape[2]
        self.slices = np.stack([slices, ~slices])

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Index:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        n, dims = values.shape
        low = values.min(axis=0)
        rest = values - low
        bits = np.array([int(x).bit_length() for x in rest.max(axis=0)], dtype=np.int64)
        index = cls(ids, low, bits, np.zeros((dims, int(bits.max(initial=0)), -(-n // 64)), dtype=np.uint64))
        for b in range(index.slices.shape[2]):
            index.slices[0, :, b] = index.pack(((rest >> b) & 1).T.astype(np.uint8))
        index.slices[1] = ~index.slices[0]
        return index

    def stored(self) -> dict[str, bytes]:
        return {"ids": self.ids.tobytes(), "low": self.low.tobytes(), "bits": self.bits.tobytes(), "slices": self.slices[0].tobytes()}

    @classmethod
    def read(cls, row: dict[str, bytes]) -> Index:
        ids, low, bits = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "low", "bits"))
        return cls(ids, low, bits, np.frombuffer(row["slices"], dtype=np.uint64).reshape(len(low), int(bits.max(initial=0)), -(-len(ids) // 64)))

    def values(self) -> np.ndarray:
        """The integers of all rows."""
        out = np.repeat(self.low[None], len(self.ids), axis=0)
        for b in range(self.slices.shape[2]):
            on = np.unpackbits(np.ascontiguousarray(self.slices[0, :, b]).view(np.uint8), axis=1, bitorder="little")[:, : len(self.ids)]
            out += on.T.astype(np.int64) << b
        return out

    def pack(self, on: np.ndarray) -> np.ndarray:
        """Rows of 0 and 1 as words; row r is bit r % 64 of word r // 64."""
        wide = np.zeros((*on.shape[:-1], self.words * 64), dtype=np.uint8)
        wide[..., : on.shape[-1]] = on
        return np.packbits(wide, axis=-1, bitorder="little").view("<u8").astype(np.uint64)

    def score_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the scores less a constant.

        A negative weight counts the complement of its dimension's bits.
        """
        size, sign = np.abs(weights), (weights < 0).astype(np.int64)
        heavy, depth = int(size.max(initial=0)).bit_length(), self.slices.shape[2]
        out, carry = [], np.zeros((0, self.words), dtype=np.uint64)
        level = 0
        while level < heavy + depth or len(carry):
            stack = [carry]
            for p in range(max(0, level - depth + 1), min(heavy, level + 1)):
                at = np.flatnonzero(((size >> p) & 1 == 1) & (self.bits > level - p))
                if len(at):
                    stack.append(self.slices[sign[at], at, level - p])
            total, carries = np.concatenate(stack), []
            while len(total) > 2:
                n = len(total) // 3 * 3
                a, b, c = total[0:n:3], total[1:n:3], total[2:n:3]
                x = a ^ b
                carries.append((a & b) | (x & c))
                total = np.concatenate([x ^ c, total[n:]])
            if len(total) == 2:
                carries.append((total[0] & total[1])[None])
                total = (total[0] ^ total[1])[None]
            out.append(total[0] if len(total) else np.zeros(self.words, dtype=np.uint64))
            carry = np.concatenate(carries) if carries else np.zeros((0, self.words), dtype=np.uint64)
            level += 1
        return out

    def top(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of the query's id."""
        open_rows = self.pack((self.ids != query_id).astype(np.uint8))
        taken = np.zeros_like(open_rows)
        found = 0
        slices = self.score_slices(weights)
        for s in reversed(slices):
            ahead = open_rows & s
            n = int(np.bitwise_count(ahead).sum())
            if found + n > k:
                open_rows = ahead
            else:
                taken |= ahead
                found += n
                open_rows = open_rows & ~s
                if found == k:
                    break
        rows = self.positions(taken)
        if found < k:
            rows = np.concatenate([rows, self.positions(open_rows)[: k - found]])
        over = np.where(weights < 0, -weights * ((1 << self.bits) - 1), 0).sum()
        scores = np.full(len(rows), int(self.low @ weights) - int(over), dtype=np.int64)
        for b, s in enumerate(slices):
            scores += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
        return self.ids[rows], scores

    @staticmethod
    def positions(on: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(on.astype("<u8").view(np.uint8), bitorder="little"))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: of 64 bits where all are small, else Python's."""
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
    if np.abs(q).max(initial=0) < WIDE:
        return q.astype(np.int64)
    flat = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(x.shape)


def _sign(score: int) -> tuple[int, int, bytes]:
    """(over, score, far): what ranks a score of any size, exactly."""
    if LEAST <= score <= MOST:
        return 0, score, b""
    far = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    far = len(far).to_bytes(4, "big") + far
    return (1, MOST, far) if score > 0 else (-1, LEAST, bytes(255 - x for x in far))


def _matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return flat.astype(np.float64).reshape(rows, -1)


def _index(rows: DataFrame, scale: int) -> DataFrame:
    """One row for each block: its index and, apart, rows with wide integers."""
    import pyarrow as pa

    kinds = pa.schema([("dims", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("ids", "low", "bits", "slices", "wide_ids", "wide"))])

    def run(keys, t):
        ids = np.array(t.column("id"), dtype=np.int64)
        x = _matrix(np.array(t.column("x").combine_chunks().flatten()), len(ids))
        with np.errstate(over="ignore"):
            small = np.abs(np.floor(x * scale)).max(axis=1, initial=0) < WIDE
        own = Index.of(ids[small], integers(x[small], scale)).stored() if small.any() else dict.fromkeys(("ids", "low", "bits", "slices"), b"")
        own |= {"wide_ids": ids[~small].tobytes(), "wide": x[~small].tobytes()}
        return pa.Table.from_pylist([{"dims": keys[0].as_py(), "block": keys[1].as_py()} | own], schema=kinds)

    return rows.groupBy("dims", "block").applyInArrow(run, "dims int, block int, ids binary, low binary, bits binary, slices binary, wide_ids binary, wide binary")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query.

    Queries are rows whose id is divisible by ``every``; all other ids are
    candidates; only vectors of equal length meet. Ties go to the smaller id.
    Null vectors, null ids and vectors with a null or non-finite component take
    no part; any finite component does, however large. Scores rank exactly; those
    that no long holds are shown as the least or greatest long. An id that
    repeats asks with its smallest vector and is a candidate with each. Empty
    vectors score 0 with one another. Empty tables give no rows. Other columns
    are ignored. The index of each block of rows is made once and stored; blocks
    meet groups of queries, each pair in its own task, which gives k rows a query.
    Rows and queries with components of 2^20 or more after scaling leave the
    bitmaps for plain integers, so many of those take long.
    """
    import pyarrow as pa

    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).filter(ok)
    v = v.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")).withColumn("dims", F.size("x"))
    asked = cut(v.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x")).withColumn("dims", F.size("x")), "queries")
    blocks, groups = max(1, -(-v.count() // BLOCK)), max(1, -(-asked.count() // GROUP))
    deal = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = cut(_index(v.withColumn("block", deal(3, blocks)), scale), "index").withColumn("part", spread(groups))
    asks = asked.withColumn("part", deal(5, groups)).withColumn("block", spread(blocks))
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("over", pa.int32()), ("score", pa.int64()), ("far", pa.binary())])

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        row = {c: left.column(c)[0].as_py() for c in ("ids", "low", "bits", "slices", "wide_ids", "wide")}
        dims = left.column("dims")[0].as_py()
        index = Index.read(row) if row["ids"] else None
        wide_ids = np.frombuffer(row["wide_ids"], dtype=np.int64)
        wide = integers(np.frombuffer(row["wide"], dtype=np.float64).reshape(len(wide_ids), dims), scale).astype(object)
        plain = None
        x = _matrix(np.array(right.column("x").combine_chunks().flatten()), right.num_rows)
        out: tuple[list, ...] = ([], [], [], [], [])
        for q, v in zip(right.column("id").to_pylist(), x):
            w = integers(v, scale)
            found = []
            if index is not None and w.dtype != object:
                found += [(-int(s), i) for i, s in zip(*(z.tolist() for z in index.top(q, w, k)))]
            elif index is not None:
                plain = index.values().astype(object) if plain is None else plain
                found += [(-s, i) for i, s in zip(index.ids.tolist(), (plain @ w).tolist()) if i != q]
            if len(wide_ids):
                found += [(-s, i) for i, s in zip(wide_ids.tolist(), (wide @ w.astype(object)).tolist()) if i != q]
            best = sorted(found)[:k]
            ranked = [_sign(-s) for s, _ in best]
            for c, new in zip(out, ([q] * len(best), [i for _, i in best], *([r[n] for r in ranked] for n in range(3)))):
                c.extend(new)
        return pa.table([pa.array(c, kind.type) for c, kind in zip(out, kinds)], schema=kinds)

    keys = ("dims", "block", "part")
    best = index.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, over int, score long, far binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), F.desc("far"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

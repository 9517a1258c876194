"""Bands and cells of tables from detected boxes: whole batches of tables as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of texts and cells that are compared at once.
PAIRS = 1 << 18


class Lists:
    """The lists of a column (null: empty): sizes, starts and the items' fields,
    those of a struct ``box`` among them."""

    def __init__(self, column: pa.ListArray):
        self.sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        items = column.flatten()
        self.fields = {f.name: x for f, x in zip(items.type, items.flatten())}
        if "box" in self.fields:
            box = self.fields.pop("box")
            self.fields |= {f.name: x for f, x in zip(box.type, box.flatten())}

    def __getitem__(self, name: str) -> np.ndarray:
        """Numbers; null is NaN, which no comparison holds for."""
        return self.fields[name].cast(pa.float64()).to_numpy(zero_copy_only=False)


class Bands:
    """Of each table's detected rows (or columns), by their beginning, those that
    start more than ``least`` after the last one kept; they meet halfway."""

    def __init__(self, lines: Lists, least: float = 10.0):
        lo, hi = lines["lo"], lines["hi"]
        order = np.lexsort((hi, lo, lines.of))
        lo, hi = lo[order], hi[order]
        keep, last = np.zeros(len(lo), bool), np.full(len(lines.sizes), -np.inf)
        todo = np.flatnonzero(lines.sizes > 0)
        step = 0
        while len(todo):
            at = lines.starts[todo] + step
            far = np.abs(lo[at] - last[todo]) > least
            keep[at[far]] = True
            last[todo[far]] = lo[at[far]]
            step += 1
            todo = todo[lines.sizes[todo] > step]
        self.lo, self.hi, self.of = lo[keep], hi[keep], lines.of[keep]
        self.sizes = np.bincount(self.of, minlength=len(lines.sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.start, self.stop = self.lo.copy(), self.hi.copy()
        next_to = np.flatnonzero(self.of[1:] == self.of[:-1])
        self.stop[next_to] = self.start[next_to + 1] = (self.hi[next_to] + self.lo[next_to + 1]) / 2


def ranges(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each i with the ``sizes[i]`` numbers from ``first[i]``."""
    i = np.repeat(np.arange(len(sizes)), sizes)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)


def covered(lo: np.ndarray, hi: np.ndarray, of: np.ndarray, bands: Bands, least: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last band of which more than ``least`` of each extent lies in; -1: none."""
    i, j = ranges(bands.starts[of], bands.sizes[of])
    part = np.maximum(0.0, np.minimum(hi[i], bands.stop[j]) - np.maximum(lo[i], bands.start[j])) / (hi - lo)[i]
    at = np.flatnonzero(part > least)
    i, j = i[at], j[at]
    begins = np.flatnonzero(np.diff(i, prepend=-1))
    first, last = np.full(len(of), -1), np.full(len(of), -1)
    first[i[begins]], last[i[begins]] = j[begins], j[np.append(begins[1:], len(i))[: len(begins)] - 1]
    return first, last


def counting(cell: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Merges that count, in order: not those that span less, in one direction,
    than the last that counts from the same cell."""
    out = np.ones(len(cell), bool)
    _, which, times = np.unique(cell, return_inverse=True, return_counts=True)
    last: dict[int, tuple[int, int]] = {}
    for k in np.flatnonzero(times[which] > 1):
        rs, cs = last.get(cell[k], (0, 0))
        if down[k] >= rs and across[k] >= cs:
            last[cell[k]] = down[k], across[k]
        else:
            out[k] = False
    return out


def inside(texts: Lists, x1, y1, x2, y2, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, box) where over half of a text's area lies in a box of its table; boxes by table."""
    a1, b1, a2, b2 = (texts[c] for c in ("x1", "y1", "x2", "y2"))
    half = 0.5 * ((a2 - a1) * (b2 - b1))
    sizes = np.bincount(of, minlength=n)
    starts = np.cumsum(sizes) - sizes
    t = np.flatnonzero((half > 0) & (sizes[texts.of] > 0))
    ends = np.cumsum(sizes[texts.of[t]])
    found = [(t[:0], t[:0])]
    while len(t):
        k = max(1, int(np.searchsorted(ends, PAIRS, "right")))
        i, j = ranges(starts[texts.of[t[:k]]], sizes[texts.of[t[:k]]])
        i = t[i]
        w = np.minimum(a2[i], x2[j]) - np.maximum(a1[i], x1[j])
        at = np.flatnonzero(w > 0)
        i, j, w = i[at], j[at], w[at]
        h = np.maximum(0.0, np.minimum(b2[i], y2[j]) - np.maximum(b1[i], y1[j]))
        at = np.flatnonzero(w * h > half[i])
        found.append((i[at], j[at]))
        ends, t = ends[k:] - ends[k - 1], t[k:]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def cells(t: Lists, rows: Bands, cols: Bands) -> pa.ListArray:
    """Rows of cells for each table of a batch; ``tables.cells`` says how."""
    row, col = ranges(cols.starts[rows.of], cols.sizes[rows.of])  # the cells' bands, row by row
    of = rows.of[row]
    base = np.cumsum(rows.sizes * cols.sizes) - rows.sizes * cols.sizes
    cell = lambda of, r, c: base[of] + (r - rows.starts[of]) * cols.sizes[of] + c - cols.starts[of]

    x1, y1, x2, y2 = (t[c] for c in ("x1", "y1", "x2", "y2"))
    big = np.flatnonzero((x2 - x1 >= 5) & (y2 - y1 >= 5))
    r1, r2 = covered(y1[big], y2[big], t.of[big], rows, 0.3)
    c1, c2 = covered(x1[big], x2[big], t.of[big], cols, 0.25)
    wide = np.flatnonzero((r1 >= 0) & (c1 >= 0) & ((r2 > r1) | (c2 > c1)))
    r1, r2, c1, c2, m = r1[wide], r2[wide], c1[wide], c2[wide], t.of[big[wide]]
    ok = counting(cell(m, r1, c1), r2 - r1, c2 - c1)
    r1, r2, c1, c2, m = r1[ok], r2[ok], c1[ok], c2[ok], m[ok]

    master, own = np.ones(len(row), bool), cell(m, r1, c1)
    i, r = ranges(r1, r2 - r1 + 1)
    k, c = ranges(c1[i], (c2 - c1)[i] + 1)
    under = cell(m[i[k]], r[k], c)
    master[under[under != own[i[k]]]] = False
    last_row, last_col = row.copy(), col.copy()
    last_row[own], last_col[own] = r2, c2  # of merges from one cell the last stays

    at = np.flatnonzero(master)
    i, j = inside(t, cols.start[col[at]], rows.start[row[at]], cols.stop[last_col[at]], rows.stop[last_row[at]], of[at], len(t.sizes))
    order = np.argsort(j, kind="stable")
    i, j = i[order], at[j[order]]
    conf = t["conf"][i]
    known = ~np.isnan(conf)
    n = np.bincount(j[known], minlength=len(row))
    mean = np.bincount(j[known], conf[known], minlength=len(row)) / np.maximum(n, 1)
    said = t.fields["text"].is_valid().to_numpy(zero_copy_only=False)[i]
    words = pa.ListArray.from_arrays(offsets(np.bincount(j[said], minlength=len(row))), t.fields["text"].take(pa.array(i[said])))
    made = [pa.array(last_row - rows.starts[of], pa.int32()), pa.array(last_col - cols.starts[of], pa.int32()), pa.array(master), pc.binary_join(words, " "), pa.array(mean, pa.float64(), mask=n == 0)]
    lines = pa.ListArray.from_arrays(offsets(cols.sizes[rows.of]), pa.StructArray.from_arrays(made, ["r2", "c2", "is_master", "text", "conf"]))
    return pa.ListArray.from_arrays(offsets(rows.sizes), lines)


def with_bands(least: float, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tables:
        made = Bands(Lists(b.column("lines")), least)
        bands = pa.StructArray.from_arrays([pa.array(x, pa.float64(), from_pandas=True) for x in (made.lo, made.hi, made.start, made.stop)], ["lo", "hi", "start", "stop"])
        yield pa.RecordBatch.from_arrays([b.column("table_id"), pa.ListArray.from_arrays(offsets(made.sizes), bands)], ["table_id", "bands"])


def with_cells(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tables:
        made = cells(Lists(b.column("texts")), Bands(Lists(b.column("rows"))), Bands(Lists(b.column("cols"))))
        yield pa.RecordBatch.from_arrays([b.column("table_id"), made], ["table_id", "cells"])

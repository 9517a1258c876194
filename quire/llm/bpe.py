"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 code points cuts each text where the hash says so, so
equal passages of different documents give equal chunks wherever they stand. A
worker encodes each chunk once and keeps the ids (bounded, oldest out first).
A cut may split a pre-token or change what stands next to it, so each join is
repaired: the end of the text so far that the cut could touch is encoded again
with the head of the next chunk, over a growing window, until a pre-token
boundary of that window is one of the chunk's own. From a common boundary on
both splits agree, since a split depends only on what follows it; the chunk's
ids are used from there to its last boundary that no later text can touch.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holds_memory
from .tokens import PretokenEncoder, encoder

#: Rolling hash: 2^BITS code points a chunk on average, MOST at most.
BITS, MOST = 9, 8192
#: Odd multiplier of the rolling hash and of its finish.
MULT, FINISH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Chunks that a worker keeps, and the longest that it keeps.
CHUNKS = 4_000
#: Boundaries of a chunk's head that a join may meet, and those tried first.
HEADS, FIRST = 24, 6
#: A split this close to the end of a text may change with what follows ('ll).
EDGE = 4


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(text)
    if n <= 1 << BITS:
        return [n]
    with np.errstate(over="ignore"):
        h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        mult = MULT
        for step in (1, 2, 4, 8):
            h[step:] += h[:-step] * np.uint64(mult & (2**64 - 1))
            mult = mult * mult
        h *= np.uint64(FINISH)
    marks = np.flatnonzero((h >> np.uint64(64 - BITS)) == 0) + 1
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m > last:
            out.append(m)
            last = m
    return out


class ChunkEncoder:
    def __init__(self, pre: PretokenEncoder, keep: int = CHUNKS):
        self.pre, self.keep = pre, keep
        self.chunks: dict[str, tuple] = {}
        self.hits = self.misses = 0

    def _sure(self, words: list[str], n: int) -> tuple[int, int]:
        """How many words at the start no later text can change, and their end."""
        k, at = len(words), n
        while k and (at >= n or at - len(words[k - 1]) > n - EDGE):
            k -= 1
            at -= len(words[k])
        return k, at

    def chunk(self, text: str) -> tuple:
        """(packed ids up to tail_at, {start: bytes before it} of the head, tail_at)."""
        found = self.chunks.get(text)
        if found is not None:
            self.hits += 1
            return found
        self.misses += 1
        words = self.pre.scan(text)
        k, tail_at = self._sure(words, len(text))
        packed = list(map(self.pre.memo.__getitem__, words[:k]))
        heads, at, size = {0: 0}, 0, 0
        for word, ids in zip(words[: min(k, HEADS - 1)], packed):
            at += len(word)
            size += len(ids)
            heads[at] = size
        found = (b"".join(packed), heads, tail_at)
        if len(self.chunks) >= self.keep:
            self.chunks.pop(next(iter(self.chunks)))
        self.chunks[text] = found
        return found

    def _join(self, out: list[bytes], tail: str, text: str) -> str:
        """Add ``text`` to ``out``; the new tail."""
        ids, heads, tail_at = self.chunk(text)
        if not tail:
            out.append(ids)
            return text[tail_at:]
        starts, memo = list(heads), self.pre.memo
        for upto in (FIRST, HEADS):
            window = tail + text[: starts[min(upto, len(starts)) - 1] + 2 * EDGE]
            words = self.pre.scan(window)
            k, _ = self._sure(words, len(window))
            at, new = -len(tail), []
            for w in words[:k]:
                new.append(memo[w])
                at += len(w)
                if at in heads:
                    out += new
                    out.append(ids[heads[at] :])
                    return text[tail_at:]
        window = tail + text
        words = self.pre.scan(window)
        k, at = self._sure(words, len(window))
        out += map(memo.__getitem__, words[:k])
        return window[at:]

    def _plain(self, out: list[bytes], text: str) -> None:
        tail, last = "", 0
        for end in cuts(text):
            tail = self._join(out, tail, text[last:end])
            last = end
        out += map(self.pre.memo.__getitem__, self.pre.scan(tail))

    def encode(self, text: str) -> list[int]:
        if not self.pre.splits or (not self.pre.plain and self.pre.has_special(text)):
            return self.pre.whole(text)
        out: list[bytes] = []
        for part in self.pre.special_at.split(text) if self.pre.special_at else [text]:
            if part in self.pre.special:
                out.append(array(self.pre.kind, [self.pre.special[part]]).tobytes())
            elif part:
                self._plain(out, part)
        return np.frombuffer(b"".join(out), dtype=self.pre.dtype).tolist()


_CHUNKERS: dict[str, ChunkEncoder] = {}
holds_memory("tokens", lambda: [c.chunks.clear() for c in _CHUNKERS.values()])


def chunker(path: str) -> ChunkEncoder:
    pre = encoder(path)
    if path not in _CHUNKERS:
        _CHUNKERS[path] = ChunkEncoder(pre)
    return _CHUNKERS[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) per row of ``docs``.

    A null or empty text has no ids. Rows that repeat stay; an empty table gives
    no rows; other columns are ignored. ``vocabulary`` is a tokenizer file that
    every machine has.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        enc = chunker(vocabulary)
        for b in batches:
            ids = [np.array(enc.encode(t or ""), dtype=np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>")
    return out.withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) per row of ``tokens``; null ids give an empty text."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        tok = encoder(vocabulary).tok
        for b in batches:
            texts = [tok.decode(x or [], skip_special_tokens=False) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    out = tokens.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"_id {kind}, text string")
    return out.withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: id_col, n_tokens, ids_sha256, decoded_sha256 and, if
    asked for, ids.

    Encoding and decoding in one pass over the texts, without a shuffle; the
    restored text stays in the worker and its digest leaves it. Nulls, repeats
    and other columns as in ``encode``.
    """
    import pyarrow as pa

    names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]

    def run(batches: Iterator) -> Iterator:
        enc = chunker(vocabulary)
        tok = enc.pre.tok
        name = [str(i) for i in range(enc.pre.vocab)]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                piece = b.slice(at, 1000)
                n, a, d, each = [], [], [], []
                for t in piece.column(1):
                    ids = enc.encode(t.as_py() or "")
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                    d.append(hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
                    if with_ids:
                        each.append(np.array(ids, dtype=np.int32))
                columns = [piece.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(each, pa.list_(pa.int32()))] * with_ids, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("_id", id_col)

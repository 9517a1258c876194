"""Repeated passages by a sparse suffix array over minimiser positions.

A document keeps the suffixes that start where the hash of ``GRAM`` words is the
least of ``WINDOW`` in a row. Any passage of ``min_words`` words holds such a
window within its first words, so all its occurrences keep a suffix at the same
place of it, with ``prefix`` = min_words - WINDOW + 1 words of the passage after
it. Suffixes are sorted by (hash of their first ``prefix`` words, id, position),
which puts equal ones side by side, and each is compared with its neighbour.
Neighbours that follow one another in both documents at one distance are one
match; its ends are then extended word by word to the left and to the right.
Neighbours may be of one document, so a passage that it holds several times is
found at all its places. Where some neighbours in a group of three or more do not
share all words that a window of ``min_words`` around the suffix can reach, the
suffixes of the group are sorted again by whole windows, so that no suffix
between two others in the sort hides what those share.

The sort is by ranges of the whole key, so a passage that a third of all
documents hold is spread over tasks; m occurrences give m - 1 matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, trimmed, worker
from .ngram_join import bloom, passes
from .shingles import grams, mixed, runs, word_hashes

#: Words of the hash that picks positions, and positions of which one is picked.
GRAM, WINDOW = 8, 18
#: Words to either side that a match may grow by at first. Where other
#: documents stand between in the sort a match may grow further; such ends are
#: compared again over ``FURTHER`` times as many words, until all have stopped.
REACH, FURTHER = 60, 16


def sliding(values: np.ndarray, window: int, best) -> np.ndarray:
    """The ``best`` (np.minimum or np.maximum) of each ``window`` values in a row."""
    n, out, span = len(values) - window + 1, values, 1
    while span * 2 <= window:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[:n], out[window - span : window - span + n])


def picked(hashes: np.ndarray, left: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions with the least gram hash of some ``window`` positions in a row.

    ``hashes`` are the words of documents one after another, and ``left`` the
    number of words from each position to the end of its document.
    """
    if len(hashes) < window + gram - 1:
        return np.zeros(0, dtype=np.int64)
    h = mixed(grams(hashes, gram), 40) | np.uint64(1)
    low = sliding(h, window, np.minimum)
    low[left[: len(low)] < window + gram - 1] = 0
    edge = np.zeros(window - 1, dtype=np.uint64)
    # A window's least hash is one's own where the greatest of them is: they hold it and are no more than it.
    return np.flatnonzero(sliding(np.concatenate([edge, low, edge]), window, np.maximum) == h)


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(g, id, pos): kept suffixes, g the hash of their first words."""
    import pyarrow as pa

    prefix = min_words - WINDOW + 1

    @worker("shingles")
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                piece = b.slice(at, 500)
                words = [(i, word_hashes(t.as_py())) for i, t in zip(piece.column(0).to_pylist(), piece.column(1)) if i is not None and t.is_valid]
                words = [(i, h) for i, h in words if len(h) >= min_words]
                if not words:
                    continue
                size = np.array([len(h) for _, h in words])
                flat, end = np.concatenate([h for _, h in words]), np.cumsum(size)
                left = np.repeat(end, size) - np.arange(len(flat))
                p = picked(flat, left, GRAM, WINDOW)
                p = p[left[p] >= prefix]
                doc = np.searchsorted(end, p, side="right")
                ids = np.array([i for i, _ in words], dtype=np.int64)[doc]
                pos = (p - (end - size)[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (runs(flat, prefix)[p].view(np.int64), ids, pos)], names=["g", "id", "pos"])

    return docs.mapInArrow(run, "g long, id long, pos int")


def neighbours(kept: DataFrame) -> DataFrame:
    """(g, a, pa, b, pb, alone): suffixes side by side in the sort that begin
    alike, of two documents or at two places of one; alone is 1 where the two
    surely are their whole group. Each task also gives its first and last suffix,
    and those few are compared across the bounds of tasks."""
    import pyarrow as pa

    names = ["g", "a", "pa", "b", "pb", "alone", "part", "edge"]

    @trimmed
    def run(batches: Iterator) -> Iterator:
        part, last, first = TaskContext.get().partitionId(), None, None
        for t in batches:
            if not t.num_rows:
                continue
            g, i, p = (t.column(k).to_numpy() for k in range(3))
            if last is None:
                first = (g[0], i[0], p[0])
            else:
                g, i, p = (np.concatenate([[x], y]) for x, y in zip(last, (g, i, p)))
            same = g[1:] == g[:-1]
            on = np.flatnonzero(same & ((i[1:] != i[:-1]) | (p[1:] != p[:-1])))
            beside = np.concatenate([[True], same, [True]])
            yield rows(g[on], i[on], p[on], i[on + 1], p[on + 1], ~(beside[on] | beside[on + 2]), part, 0)
            last = (g[-1], i[-1], p[-1])
        if first is not None:
            for edge, x in ((1, first), (2, last)):
                yield rows(*(np.array([v]) for v in (*x, 0, 0, 0)), part, edge)

    def rows(g, a, pa_, b, pb, alone, part, edge):
        n = len(g)
        cols = [pa.array(x.astype(np.int64)) for x in (g, a, pa_, b, pb, alone)] + [pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, edge, np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    ordered = kept.repartitionByRange("g", "id", "pos").sortWithinPartitions("g", "id", "pos")
    found = cut(ordered.mapInArrow(run, ", ".join(f"{x} long" for x in names)), "neighbours")
    order = Window.orderBy("part", "edge")
    edges = found.filter("edge > 0").select("g", "a", "pa", "part", "edge")
    nxt = [F.lead(c).over(order).alias(f"n{c}") for c in ("g", "a", "pa", "edge")]
    over = edges.select("g", "a", "pa", "edge", *nxt).filter("edge = 2 and nedge = 1 and g = ng and (a <> na or pa <> npa)")
    return found.filter("edge = 0").drop("part", "edge").unionByName(over.select("g", "a", "pa", F.col("na").alias("b"), F.col("npa").alias("pb"), F.lit(0).cast("long").alias("alone")))


def one_way(pairs: DataFrame) -> DataFrame:
    """(g, a, b, pos, shift): the smaller id first, its place, and how much
    farther on the place in the other is; of one document the earlier place."""
    turned = F.col("a") > F.col("b")
    pos, other = F.when(turned, F.col("pb")).otherwise(F.col("pa")), F.when(turned, F.col("pa")).otherwise(F.col("pb"))
    return pairs.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), pos.alias("pos"), (other - pos).alias("shift"))


def chained(pairs: DataFrame, prefix: int) -> DataFrame:
    """(match, a, b, shift, first, last): pairs at one distance whose words
    overlap or touch, as one match over words [first, last) of a."""
    pairs = one_way(pairs).drop("g")
    order = Window.partitionBy("a", "b", "shift").orderBy("pos")
    fresh = F.coalesce((F.col("pos") - F.lag("pos").over(order) > prefix).cast("int"), F.lit(0))
    island = F.sum("fresh").over(order)
    found = pairs.withColumn("fresh", fresh).withColumn("island", island)
    out = found.groupBy("a", "b", "shift", "island").agg(F.min("pos").alias("first"), (F.max("pos") + prefix).alias("last"))
    return out.select(F.xxhash64("a", "b", "shift", "first").alias("match"), "a", "b", "shift", "first", "last")


def mixed_groups(pairs: DataFrame, grown: DataFrame, min_words: int) -> DataFrame:
    """(g): groups of three or more suffixes in which some neighbours do not share
    all words that windows of ``min_words`` words around the suffix hold."""
    prefix = min_words - WINDOW + 1
    low = F.when(F.col("starts"), -WINDOW).otherwise(F.col("first") - F.col("left"))
    high = F.when(F.col("ends"), F.lit(2**31 - 1)).otherwise(F.col("last") + F.col("right"))
    p = one_way(pairs.filter("alone = 0")).alias("p")
    s = grown.select("a", "b", "shift", "first", "last", low.alias("low"), high.alias("high")).alias("s")
    same = (F.col("p.a") == F.col("s.a")) & (F.col("p.b") == F.col("s.b")) & (F.col("p.shift") == F.col("s.shift"))
    same &= (F.col("p.pos") >= F.col("s.first")) & (F.col("p.pos") + prefix <= F.col("s.last"))
    whole = (F.col("p.pos") - (WINDOW - 1) >= F.col("s.low")) & (F.col("p.pos") + min_words <= F.col("s.high"))
    return p.join(s, same & whole, "left_anti").select("g").distinct()


def windows(docs: DataFrame, kept: DataFrame, groups: DataFrame, min_words: int) -> DataFrame:
    """(g, id, pos): all windows of ``min_words`` words around suffixes of
    ``groups``, in which not all neighbours share all words around.

    In such a group two places that do share enough may not be neighbours;
    sorted by whole windows they are. Other groups need none of this.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(bloom(groups.select(F.col("g").alias("id"))))

    @trimmed
    def some(batches: Iterator) -> Iterator:
        for t in batches:
            yield t.filter(pa.array(passes(shared.value, t.column(0))))

    members = kept.mapInArrow(some, "g long, id long, pos int").join(groups, "g", "left_semi")
    members = cut(members.groupBy("id").agg(F.collect_set("pos").alias("at")), "members")
    holders = docs.sparkSession.sparkContext.broadcast(bloom(members.select("id")))

    @trimmed
    def wanted(batches: Iterator) -> Iterator:
        for t in batches:
            yield t.filter(pa.array(passes(holders.value, t.column(0))))

    @worker("shingles")
    def run(batches: Iterator) -> Iterator:
        for t in batches:
            for i, text, at in zip(t.column(0).to_pylist(), t.column(1), t.column(2)):
                h = word_hashes(text.as_py())
                if len(h) < min_words:
                    continue
                start = np.array(at.as_py(), dtype=np.int64)[:, None] - np.arange(WINDOW)[None]
                start = np.unique(start[(start >= 0) & (start + min_words <= len(h))])
                if len(start):
                    yield pa.RecordBatch.from_arrays([pa.array(runs(h, min_words)[start].view(np.int64)), pa.array(np.full(len(start), i, dtype=np.int64)), pa.array(start.astype(np.int32))], names=["g", "id", "pos"])

    texts = docs.mapInArrow(wanted, "id long, text string")
    return texts.join(members, "id").select("id", "text", "at").mapInArrow(run, "g long, id long, pos int")


def compared(docs: DataFrame, matches: DataFrame, reach: int) -> DataFrame:
    """``matches`` with left and right, the words that each end grows by, up to
    ``reach``, and starts and ends, whether both documents start or end there.
    Two places of one document have to be alike in one row of it.

    Only documents in matches are read again; of those, only the words beside
    the ends of their matches travel, as hashes.
    """
    import pyarrow as pa

    ends = [matches.select(F.col(side).alias("id"), "match", F.lit(side).alias("side"), (F.col("a") == F.col("b")).alias("own"), (F.col("first") + (F.col("shift") if side == "b" else 0)).alias("x"), (F.col("last") + (F.col("shift") if side == "b" else 0)).alias("y")) for side in ("a", "b")]
    asked = ends[0].unionByName(ends[1])
    shared = docs.sparkSession.sparkContext.broadcast(bloom(asked.select("id").distinct()))

    @trimmed
    def some(batches: Iterator) -> Iterator:
        for t in batches:
            yield t.filter(pa.array(passes(shared.value, t.column(0))))

    wanted = docs.mapInArrow(some, "id long, text string")
    asks = asked.groupBy("id").agg(F.collect_list(F.struct("match", "side", "own", "x", "y")).alias("asks"))

    @worker("shingles")
    def run(batches: Iterator) -> Iterator:
        for t in batches:
            for text, asks in zip(t.column(0), t.column(1)):
                h = word_hashes(text.as_py()).view(np.int64)
                cols: tuple[list, ...] = ([], [], [], [], [])
                seed = xxhash.xxh3_64_intdigest(h.tobytes())
                for q in asks.as_py():
                    x, y = q["x"], q["y"]
                    row = xxhash.xxh3_64_intdigest(h[x:y].tobytes(), seed) >> 1 if q["own"] else 0
                    values = (q["match"], q["side"], row, h[max(0, x - reach) : x][::-1].tobytes(), h[y : y + reach].tobytes())
                    for c, v in zip(cols, values):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["match", "side", "row", "l", "r"])

    @trimmed
    def met(batches: Iterator) -> Iterator:
        """Rows come in the order of (match, row, side); of each (match, row) all
        of side a meet all of side b, which are one and one unless ids repeat."""
        key, sides = None, {"a": set(), "b": set()}

        def rows(out: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["match", "left", "right", "starts", "ends"])

        def of_key() -> Iterator:
            for la, ra in sides["a"]:
                for lb, rb in sides["b"]:
                    left, right = alike(la, lb), alike(ra, rb)
                    yield key[0], left, right, 8 * left == len(la) == len(lb), 8 * right == len(ra) == len(rb)

        for t in batches:
            out = []
            for match, side, row, left, right in zip(*(c.to_pylist() for c in t.columns)):
                if (match, row) != key:
                    out += of_key()
                    key, sides = (match, row), {"a": set(), "b": set()}
                sides[side].add((left, right))
            if out:
                yield rows(out)
        if last := list(of_key()):
            yield rows(last)

    beside = wanted.join(asks, "id").select("text", "asks").mapInArrow(run, "match long, side string, row long, l binary, r binary")
    both = beside.repartition("match", "row").sortWithinPartitions("match", "row", "side").mapInArrow(met, "match long, left int, right int, starts boolean, ends boolean")
    grown = both.groupBy("match").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.min("starts").alias("starts"), F.min("ends").alias("ends"))
    return matches.join(grown, "match")


def alike(x: bytes, y: bytes) -> int:
    """How many 64-bit hashes at the start of x and y are the same."""
    if x == y:
        return len(x) // 8
    n = min(len(x), len(y))
    differ = np.flatnonzero(np.frombuffer(x[:n], dtype=np.int64) != np.frombuffer(y[:n], dtype=np.int64))
    return int(differ[0]) if len(differ) else n // 8


def extended(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """``matches`` with left and right, up to the first words that differ."""
    reach, done = REACH, None
    while True:
        grown = cut(compared(docs, matches, reach), "grown")
        on = (F.col("left") == reach) | (F.col("right") == reach)
        done = grown.filter(~on) if done is None else done.unionByName(grown.filter(~on))
        if not grown.filter(on).limit(1).count():
            return done
        matches, reach = grown.filter(on).drop("left", "right", "starts", "ends"), reach * FURTHER


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, other_id, other_start): passages of at
    least ``min_words`` words, A-Z lower-cased, that stand at two places, of two
    documents or of one (other_id = doc_id; the places may overlap).

    Each match gives a row for either place; words [start_word, end_word) are
    counted from 0 over the whole text. An occurrence is matched with its
    neighbours in the sort, so the places of a passage are connected by rows,
    without a row for every two, and every occurrence of every such window of
    ``min_words`` words lies in a row. Null ids and texts, and shorter texts, give
    no row. Rows that repeat an id are one document: its rows are not matched
    with one another, and where their texts differ not all places within one row
    are. An empty table gives no rows. Other columns are ignored.
    """
    prefix = min_words - WINDOW + 1
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = cut(suffixes(text, min_words), "suffixes")
    pairs = neighbours(kept)
    grown = extended(text, cut(chained(pairs, prefix), "matches"))
    enough = F.col("last") + F.col("right") - F.col("first") + F.col("left") >= min_words
    found = grown.filter(enough)
    groups = cut(mixed_groups(pairs, grown, min_words), "mixed-groups")
    if groups.limit(1).count():
        whole = neighbours(cut(windows(text, kept, groups, min_words), "windows"))
        found = found.unionByName(extended(text, cut(chained(whole, min_words), "matches")))
    found = found.select("a", "b", "shift", (F.col("first") - F.col("left")).alias("x"), (F.col("last") + F.col("right")).alias("y")).distinct()
    a = found.select(F.col("a").alias(id_col), F.col("x").alias("start_word"), F.col("y").alias("end_word"), F.col("b").alias("other_id"), (F.col("x") + F.col("shift")).alias("other_start"))
    b = found.select(F.col("b").alias(id_col), (F.col("x") + F.col("shift")).alias("start_word"), (F.col("y") + F.col("shift")).alias("end_word"), F.col("a").alias("other_id"), F.col("x").alias("other_start"))
    return a.unionByName(b)


def drop_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without passages that a smaller id, or the document itself farther
    up, holds too; words are joined by blanks where something was cut, other texts
    stay as they are. Columns of any name pass through."""
    again = (F.col("other_id") == F.col(id_col)) & (F.col("other_start") < F.col("start_word"))
    cuts = passages.filter((F.col("other_id") < F.col(id_col)) | again).groupBy(F.col(id_col).alias("_id")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("_cuts"))
    own = F.col("_row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.join(cuts, own[id_col] == F.col("_id"), "left")
    words = F.split(F.regexp_replace(own[text_col], "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""), "[\\x20\\x09-\\x0D]+")
    kept = F.filter(words, lambda w, i: ~F.exists("_cuts", lambda c: (i >= c["start_word"]) & (i < c["end_word"])))
    text = F.when(F.col("_cuts").isNull(), own[text_col]).otherwise(F.array_join(kept, " "))
    return rows.select(*[(text if c == text_col else own[c]).alias(c) for c in docs.columns])

"""N-gram Jaccard join by filtering under several global token orders.

Two sets of n tokens with Jaccard similarity t share a token among the first
n - ceil(t n) + 1 of each, whatever global order the tokens have. Order 1 puts
rare tokens first and makes the candidates: sets that share a prefix token.
Orders 2 and 3 are by independent hashes; each set carries a bitmap of its
prefix under them, and candidates whose bitmaps share no bit are dropped. Two
more necessary conditions follow: the sizes, and a parity bitmap of the set,
whose Hamming distance is at most the symmetric difference. What is left is
verified on the whole sets.

Equal sets are one class from the start, known by a number and by the 128-bit
signature of the set; ids of documents matter only at the end, so they may be
null or repeat. Before candidates are made, sets that share their two first
tokens under a hash order are compared with a few pivots of that group, the most
typical ones. What verified links connect is one family from then on. Of the
sets that hold a token only those outside its largest family meet the others: if
many hold it, at first a few of that family, to join it by any link, again while
that makes the family larger, and then, if they have not joined it, all. So a
family of m copies costs about m comparisons and not m^2.

Joins on keys that many rows may share (copies, pivots, tokens, labels) are plain
joins of stored tables, whose large partitions Spark splits between tasks.

Token frequencies come from lossy counting: each batch of documents reports the
tokens that it holds ``LOCAL`` times or more, which misses at most LOCAL - 1 for
each batch. Errors there, and tokens beyond the table's bound, change the order
and the time, and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_and_release, discard, trimmed, worker
from .components import components
from .shingles import mixed, shingle_sets

#: Lossy counting: the least count in a batch; most tokens in the table.
LOCAL, TABLE = 2, 1 << 18
#: Tokens of a batch.
COUNTED = 8_000_000
#: Pivots that each set of a group is compared with under a hash order.
PIVOTS = 2
#: Sets outside a token's largest family first meet about so many of its members
#: where more than CROWD sets hold the token; this is repeated while the pairs that
#: such tokens have to come are more than AHEAD times all rows, fewer by a quarter
#: each time. All other pairs meet afterwards, whatever these numbers are.
FEW, CROWD, AHEAD = 4, 32, 4
#: Bits of the filter that says which texts a verification needs. It is of fixed
#: size: beyond some 10^8 texts it lets most pass, and the join behind it decides.
BLOOM_BITS = 1 << 25
#: Words of 64 bits: of the parity bitmap that joins carry, and of the long one
#: that pairs are sieved with before their texts move.
PARITY, LONG, ORDERS = 4, 64, (2, 3)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


HEAD = "id long, rk long, n long, siga long, sigb long, " + ", ".join(f"bm{i} long" for i in range(PARITY)) + ", " + ", ".join(f"p{j}{i} long" for j in ORDERS for i in range(2)) + ", mh2 long, mh3 long, mh4 long, sketch array<long>, token long, df long"
NAMES = [x.split()[0] for x in HEAD.split(", ")]
NUMBERS = NAMES[NAMES.index("siga") : NAMES.index("sketch")]


def _pieces(batches: Iterator, most: int = 1000) -> Iterator:
    """Columns of batches in pieces of few documents, so that flat arrays stay small."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield [c.to_pylist() for c in b.slice(at, most).columns]


def _words_of_bits(doc: np.ndarray, bit: np.ndarray, docs: int, words: int, parity: bool) -> np.ndarray:
    """Bitmaps of ``words`` 64-bit words a document, from (document, bit) pairs."""
    found = np.bincount(doc * (64 * words) + bit, minlength=docs * 64 * words).reshape(docs, -1)
    return np.packbits((found & 1 if parity else found > 0).astype(np.uint8), axis=1).view("<i8")


def _summaries(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns siga to mh4 of non-empty sets, a row for each, and sketches."""
    size = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    columns = [np.add.reduceat(mixed(flat, salt), first).view(np.int64)[:, None] for salt in (11, 12)]
    columns.append(_words_of_bits(doc, (mixed(flat, 9) >> np.uint64(8)).astype(np.int64) % (64 * PARITY), len(sets), PARITY, True))
    lows = []
    for j in (*ORDERS, 4):
        h = mixed(flat, j)
        if j in ORDERS:
            cut_at = np.empty(len(sets), dtype=np.uint64)
            for i, (a, n) in enumerate(zip(first.tolist(), size.tolist())):
                p = prefix_length(n, percent) - 1
                cut_at[i] = np.partition(h[a : a + n], p)[p]
            early = np.flatnonzero(h <= cut_at[doc])
            columns.append(_words_of_bits(doc[early], (mixed(flat[early], 30 + j) >> np.uint64(8)).astype(np.int64) % 128, len(sets), 2, False))
        low = np.minimum.reduceat(h, first)
        h[h == low[doc]] = np.uint64(2**64 - 1)
        lows.append((low ^ (np.minimum.reduceat(h, first) << np.uint64(1))).view(np.int64)[:, None])
    sketch = _words_of_bits(doc, (mixed(flat, 8) >> np.uint64(8)).astype(np.int64) % (64 * LONG), len(sets), LONG, True)
    return np.concatenate([*columns, *lows], axis=1), sketch


def _speakers(rks: list[int], sets: list) -> set[int]:
    """Positions of the rows that speak for their set: the least rk of equal sets."""
    best: dict[object, int] = {}
    for i, key in enumerate(sets):
        if key is not None and (key not in best or rks[best[key]] > rks[i]):
            best[key] = i
    return set(best.values())


def heads(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row for each document (token null), and counted tokens (id and n null).

    Of equal sets in a piece of a batch the least rk speaks: its row alone has a
    sketch, and the least rk of a class is always among those that speak."""
    import pyarrow as pa

    @worker("shingles")
    def run(batches: Iterator) -> Iterator:
        seen: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(seen), return_counts=True)
            often = count >= LOCAL
            n = int(often.sum())
            nulls = [pa.nulls(n, pa.int64())] * (3 + len(NUMBERS)) + [pa.nulls(n, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=NAMES)

        for ids, rks, texts in _pieces(batches):
            sets = shingle_sets(texts, k)
            some = [i for i, s in enumerate(sets) if len(s)]
            n = len(sets)
            values, sketch = np.zeros((n, len(NUMBERS)), dtype=np.int64), np.zeros((n, LONG), dtype=np.int64)
            if some:
                values[some], sketch[some] = _summaries([sets[i] for i in some], percent)
                seen += sets
                held += sum(map(len, sets))
            speak = _speakers(rks, [(a, b) if len(s) else None for s, a, b in zip(sets, values[:, 0].tolist(), values[:, 1].tolist())])
            sketches = [sketch[i] if i in speak else None for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rks, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in values.T), pa.array(sketches, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=NAMES)
            if held > COUNTED:
                yield counted()
                seen, held = [], 0
        if seen:
            yield counted()

    return docs.mapInArrow(run, HEAD)


def frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that are counted most, at most TABLE, and their levels; the
    driver gets a histogram of levels, then those tokens."""
    level = F.least(F.lit(1023), F.ceil(16 * F.log2(F.greatest(F.sum("df"), F.lit(1))))).cast("int")
    levels = cut(counted.groupBy("token").agg(level.alias("level")), "tokens")
    least, n = 1024, 0
    for row in sorted(levels.groupBy("level").count().collect(), reverse=True):
        n += row["count"]
        if n > TABLE:
            break
        least = row["level"]
    table = levels.filter(F.col("level") >= least).toPandas()
    tokens = table["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table["level"].to_numpy(dtype=np.int64)[order]


def prefixes(docs: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """(token, rk): the prefix under order 1, rare tokens first, of rows that
    speak for their set; ``shared`` has the broadcast frequent tokens."""
    import pyarrow as pa

    @worker("shingles")
    def run(batches: Iterator) -> Iterator:
        tokens, level = shared.value
        maybe = np.zeros(1 << 22, dtype=bool)
        maybe[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for rks, texts in _pieces(batches):
            every = shingle_sets(texts, k)
            speak = sorted(_speakers(rks, [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in every]))
            if not speak:
                continue
            sets = [every[i] for i in speak]
            flat = np.concatenate(sets)
            rank = np.zeros(len(flat), dtype=np.uint64)
            hot = np.flatnonzero(maybe[(flat & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if len(hot):
                at = np.searchsorted(tokens, flat[hot])
                at[at == len(tokens)] = 0
                rank[hot] = np.where(tokens[at] == flat[hot], level[at], 0).astype(np.uint64)
            key = (rank << np.uint64(54)) | (mixed(flat, 1) >> np.uint64(10))
            found, at = [], 0
            for s in sets:
                n = len(s)
                p = prefix_length(n, percent)
                found.append(s if p >= n else s[np.argpartition(key[at : at + n], p - 1)[:p]])
                at += n
            who = np.repeat(np.array([rks[i] for i in speak], dtype=np.int64), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(who)], names=["token", "rk"])

    return docs.mapInArrow(run, "token long, rk long")


def _bloom_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(ids.astype(np.uint64), 21)
    return (h % np.uint64(BLOOM_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def bloom(ids: DataFrame) -> np.ndarray:
    """A filter of BLOOM_BITS bits over the column id, as 64-bit words."""
    import pyarrow as pa

    def places(batches: Iterator) -> Iterator:
        for b in batches:
            at = np.unique(np.concatenate(_bloom_places(b.column(0).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bits"])

    bits = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    united = ids.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits[united["word"].to_numpy(dtype=np.int64)] = united["bits"].to_numpy(dtype=np.int64)
    return bits


def passes(bits: np.ndarray, ids) -> np.ndarray:
    """Which of an Arrow column of ids the filter lets pass; null ones never."""
    ok = ~np.asarray(ids.is_null())
    whole = np.where(ok, ids.to_numpy(zero_copy_only=False), 0).astype(np.int64)
    for at in _bloom_places(whole):
        ok &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return ok


_SIDE = ["rk", "siga", "sigb"]


def _sides(pairs: DataFrame) -> DataFrame:
    """The distinct (rk, siga, sigb) of both sides of pairs."""
    a, b = (pairs.select(*[F.col(f"{x}_{c}").alias(c) for c in _SIDE]) for x in "ab")
    return a.unionByName(b).distinct()


def verified(docs: DataFrame, k: int, percent: int, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets are at least ``percent`` similar.

    Only documents in pairs leave the scan, as texts, which are a third of the
    size of their sets: b's text goes to the pair, the pair to a's text. Texts
    are found by rk, and count where their set has the signature of the class.
    """
    import pyarrow as pa

    needed = cut(_sides(pairs).select("rk").distinct(), "needed")
    shared = docs.sparkSession.sparkContext.broadcast(bloom(needed.select(F.col("rk").alias("id"))))

    @trimmed
    def some(batches: Iterator) -> Iterator:
        for t in batches:
            yield t.filter(pa.array(passes(shared.value, t.column(0))))

    @worker("shingles")
    def compared(batches: Iterator) -> Iterator:
        for t in batches:
            for at in range(0, t.num_rows, 500):
                piece = t.slice(at, 500)
                left, right = (shingle_sets(piece.column(c).to_pylist(), k) for c in ("ta", "tb"))
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)])
                both = np.array([len(x) + len(y) for x, y in zip(left, right)]) - common
                own = np.ones(piece.num_rows, dtype=bool)
                for side, sets in (("a", left), ("b", right)):
                    for salt, c in ((11, "siga"), (12, "sigb")):
                        own &= np.array([mixed(s, salt).sum(dtype=np.uint64).view(np.int64) for s in sets]) == piece.column(f"{side}_{c}").to_numpy()
                yield piece.select(["a", "b"]).filter(pa.array((100 * common >= percent * both) & own))

    texts = docs.select("rk", "text").mapInArrow(some, "rk long, text string").join(needed, "rk", "left_semi").dropDuplicates(["rk", "text"])
    texts = cut_and_release(texts, "texts", shared)
    half = pairs.join(texts.select(F.col("rk").alias("b_rk"), F.col("text").alias("tb")), "b_rk")
    whole = half.join(texts.select(F.col("rk").alias("a_rk"), F.col("text").alias("ta")), "a_rk")
    links = cut(whole.select("a", "b", "a_siga", "a_sigb", "b_siga", "b_sigb", "ta", "tb").mapInArrow(compared, "a long, b long"), "links")
    discard(texts)
    return links


def may_link(x: str, y: str, percent: int) -> Column:
    """Necessary conditions of a link: sizes and parity bitmaps of columns that begin with x and y."""
    c = lambda side, name: F.col(f"{side}{name}")
    low, high = F.least(c(x, "n"), c(y, "n")), F.greatest(c(x, "n"), c(y, "n"))
    ok = F.lit(100) * low >= F.lit(percent) * high
    apart = sum((F.bit_count(c(x, f"bm{i}").bitwiseXOR(c(y, f"bm{i}"))) for i in range(PARITY)), F.lit(0))
    ok &= F.lit(100 + percent) * apart <= F.lit(100 - percent) * (low + high)
    return ok


_SIEVE = ["n", *(f"bm{i}" for i in range(PARITY))]
_ORDERS = [f"p{j}{i}" for j in ORDERS for i in range(2)]


def in_all_orders(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys that may link and whose prefixes meet under the
    other orders too, with rk and signature of both sides."""
    columns = [*_SIDE, *_SIEVE, *_ORDERS]
    side = lambda s: reps.select(F.col("key").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_link("a_", "b_", percent))
    for j in ORDERS:
        shared = [F.col(f"a_p{j}{i}").bitwiseAND(F.col(f"b_p{j}{i}")) != 0 for i in range(2)]
        both = both.filter(shared[0] | shared[1])
    return both.select("a", "b", *[f"{s}_{c}" for s in "ab" for c in _SIDE])


def sieved(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose long parity bitmaps differ in no more bits than linked
    sets can; ``sketches`` has (rk, siga, sigb, n, sketch), equal rows for equal keys."""
    own = cut(sketches.join(cut(_sides(pairs), "sides"), _SIDE, "left_semi").dropDuplicates(_SIDE), "sketches")
    side = lambda s: own.select(*[F.col(c).alias(f"{s}_{c}") for c in _SIDE], F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    both = pairs
    for s in "ab":
        both = both.join(side(s), [f"{s}_{c}" for c in _SIDE])
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.filter(F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("na") + F.col("nb"))).select(*pairs.columns)


def _stars(reps: DataFrame) -> DataFrame:
    """(a, b): each set with the pivots of its group under each hash order.

    A group's sets are dealt into PIVOTS parts; the pivot of a part is the set
    whose own keys are shared most, the most typical one.
    """
    groups = reps.select("key", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"mh{j}").alias("mh")) for j in (2, 3, 4)])).alias("g")).select("key", "g.*")
    often = cut(groups.groupBy("j", "mh").agg(F.count("*").alias("c")).filter("c > 1"), "groups")
    mine = cut(groups.join(often, ["j", "mh"]), "members")
    typical = cut(mine.groupBy("key").agg((F.sum("c") - F.count("*")).alias("typical")), "typical")
    mine = cut(mine.drop("c").join(typical, "key"), "members")
    part = F.pmod(F.xxhash64("key"), F.lit(PIVOTS))
    pivot = cut(mine.groupBy("j", "mh", part.alias("part")).agg(F.max(F.struct("typical", (-F.col("key")).alias("m"))).alias("v")).select("j", "mh", (-F.col("v.m")).alias("a")), "pivots")
    return mine.join(pivot, ["j", "mh"]).filter("a <> key").select("a", F.col("key").alias("b")).distinct()


def _met(posts: DataFrame) -> DataFrame:
    """``posts`` (token, key, family, ...) of tokens that several families hold,
    each once, with the largest of those families, ``main``, its rows, ``big``, and
    all rows of the token, ``held``."""
    held = posts.groupBy("token", "family").agg(F.count("*").alias("c"))
    main = held.groupBy("token").agg(F.max_by("family", "c").alias("main"), F.max("c").alias("big"), F.sum("c").alias("held"), F.count("*").alias("families")).filter("families > 1")
    return posts.join(cut(main.select("token", "main", "big", "held"), "shared-tokens"), "token").distinct()


_MAIN = ["main", "big", "held"]


def _ahead(met: DataFrame) -> int:
    """Pairs that sets outside their token's largest family have to come."""
    return met.filter("family <> main").agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]


def _candidates(met: DataFrame, percent: int, few: bool) -> DataFrame:
    """(a, b): sets of different families that share a token and may link; with
    ``few`` only with some of the token's largest family."""
    chosen = F.pmod(F.xxhash64("token", "key"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("big") / FEW))) == 0
    x, y = met.filter("family <> main"), met.filter((F.col("family") == F.col("main")) & chosen) if few else met
    x, y = (side.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("key", "family", "main", *_SIEVE)]) for s, side in (("x", x), ("y", y)))
    other = (F.col("x_family") != F.col("y_family")) & ((F.col("y_family") == F.col("y_main")) | (F.col("x_key") < F.col("y_key")))
    pairs = x.join(y, "token").filter(other & may_link("x_", "y_", percent))
    return pairs.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    A set is the distinct ``k``-word shingles of the whole text, A-Z
    lower-cased; fewer words are one shingle; no words, or a null text, are the
    empty set, linked with nothing. Sets of at least ``percent`` per cent
    Jaccard similarity link; component_id is the smallest id reachable. Rows
    that repeat stay; rows of one id with different texts each have their own
    set and links. A row without an id links like any other: it gets the smallest
    id that it reaches, null if none, and carries links between others. An empty
    table gives no rows. Other columns are ignored.
    """
    return labelled(docs, id_col, text_col, k, percent).select(id_col, "n_shingles", "component_id")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """``similar_sets`` with more: rk, a hash of id and text, and key, which names
    the component also where it has no id (null: no links, no copies)."""
    sc = docs.sparkSession.sparkContext
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("rk"), F.col(text_col).alias("text"))
    both = cut(heads(text, k, percent), "heads")
    rows = both.filter(F.col("token").isNull())
    sketches = rows.filter(F.col("sketch").isNotNull() & (F.col("n") > 0)).select(*_SIDE, "n", "sketch")
    often = frequent(both.filter(F.col("token").isNotNull()).select("token", "df"))
    first = [F.first(c, ignorenulls=True).alias(c) for c in (*_SIEVE, *_ORDERS, "mh2", "mh3", "mh4")]
    classes = rows.filter("n > 0").groupBy("siga", "sigb").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.min("rk").alias("rk"), *first)
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()), "classes")

    def links(found: DataFrame) -> DataFrame:
        """The pairs of keys that are similar indeed."""
        pairs = cut(in_all_orders(cut(found, "met"), classes, percent), "candidates")
        return verified(text, k, percent, cut(sieved(pairs, sketches, percent), "pairs"))

    def joined(rows: DataFrame) -> DataFrame:
        """``rows`` with the family that their key is in, itself if in no other."""
        return rows.join(families, "key", "left").withColumn("family", F.coalesce("family", "key"))

    families = components(links(_stars(classes))).select(F.col("node").alias("key"), F.col("component").alias("family"))
    shared = sc.broadcast(often)
    nodes = cut(joined(classes.select("key", "rk", *_SIEVE)), "nodes")
    posts = prefixes(text.select("rk", "text"), k, percent, shared).join(nodes.select("rk", "key", "family"), "rk")
    other = F.when(F.col("family") != F.col("key"), F.col("family"))  # most are their own, and a null takes no room
    posts = cut_and_release(posts.select("token", "key", other.alias("family")), "posts", shared)
    met = cut(_met(posts.withColumn("family", F.coalesce("family", "key"))).join(nodes.select("key", *_SIEVE), "key"), "met")
    discard(posts)
    as_links = lambda f: f.select(F.col("key").alias("a"), F.col("family").alias("b"))
    crowd, n, before = met.filter(F.col("held") > CROWD), met.count(), None
    while (pairs := _ahead(crowd)) > AHEAD * n and (before is None or 4 * pairs <= 3 * before):
        families = components(as_links(families).unionByName(links(_candidates(crowd, percent, True)))).select(F.col("node").alias("key"), F.col("component").alias("family"))
        crowd, before = cut(_met(joined(crowd.drop("family", *_MAIN))), "crowd"), pairs
    yet = met.filter(F.col("held") <= CROWD).unionByName(crowd)  # few hold the others, whatever their families are by now
    parts = components(as_links(families).unionByName(links(_candidates(yet, percent, False))))
    every = cut(rows.select("id", "rk", "n", "siga", "sigb"), "rows")
    discard(both, met)
    linked = cut(parts.join(classes.select("key", "siga", "sigb", "id"), parts["node"] == classes["key"]).select("node", "component", "siga", "sigb", "id"), "linked")
    least = cut(linked.groupBy("component").agg(F.min("id").alias("least")), "least")
    linked = linked.join(least, "component").select("siga", "sigb", F.col("component").alias("key"), "least")
    alone = classes.filter("copies > 1").join(parts, classes["key"] == parts["node"], "left_anti").select("siga", "sigb", "key", F.col("id").alias("least"))
    named = cut(linked.unionByName(alone), "named")
    rows = every.join(named.withColumnRenamed("siga", "a").withColumnRenamed("sigb", "b"), (F.col("siga") == F.col("a")) & (F.col("sigb") == F.col("b")) & (F.col("n") > 0), "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "rk", "key")

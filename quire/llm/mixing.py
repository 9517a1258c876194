"""Mix sources to target weights by a low-discrepancy schedule.

The schedule has one slot for each ``block`` words of the mix. Slot i's
golden-ratio point frac((i + 1) * phi) falls into one source's share of the
cumulative target weights, so every prefix of the schedule is close to the
targets. Slots are ranked per source. A source's documents are laid end to end in
a shuffled order, again from the first after the last, and its target is cut
into as many equal blocks (to a word) as it has slots; rank k takes block k. A
source that no point falls on has one slot after all others, so the words taken
from each source are its target, rounded, however small it is.

Sources are a table like any other: their order, shares and prefix sums come from
range partitions, and the level of the targets from a few sums. Ranks and
offsets are two levels of prefix sums over small groups, so that a source with a
third of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = "[^\\x20\\x09-\\x0D]+"
#: Cells of the unit interval, at least: a point and a share meet on their cell.
CELLS = 4096
#: Each level of the prefix sums has groups of this many members.
FAN = 128
PHI = 0.6180339887498949
#: frac(2^24 * phi), so that points stay exact for 2^48 slots.
PHI_24 = (2**24 * PHI) % 1.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _before(*by: str):
    return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(skey, source_size, target, lo, hi): each source's share of the mix.

    ``sizes`` has (skey, source, size). Weights repeat over sources in code
    point order, null last. Targets share all sizes by weight and stop at
    ``max_repeats`` times the source's size; what is over goes to the others by
    weight, until none is above. Sums are of whole numbers, so reruns agree.
    """
    per = sizes.groupBy("skey").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    # Sorted by ranges; the high bits of the id are the range, the low ones the place in it.
    per = per.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id())
    per = cut(per.select("skey", "source_size", "at", F.shiftright("at", 33).alias("part")), "mix-sources")
    first = per.groupBy("part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("first")
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.join(first.select("part", "first"), "part").withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeats).drop("first")
    per = cut(per, "mix-weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, (-1, -1)
    while True:
        capped = F.col("cap") <= F.col("w") * F.lit(level)
        caps, n, free = per.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(capped.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0))).first()
        if (caps, n) == full or not free:
            break
        full, level = (caps, n), (total - caps) / free
    whole = capped.cast("long") * F.col("cap")
    open_w = (~capped).cast("long") * F.col("w")
    per = per.withColumns({"target": F.when(capped, F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(level)), "a": whole, "b": open_w})
    base = per.groupBy("part").agg(F.sum("a").alias("a0"), F.sum("b").alias("b0"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("part", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("a0", "b0")])
    own = Window.partitionBy("part").orderBy("at")
    sums = {f"{c}{k}": F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -k)), F.lit(0)) for c in "ab" for k in (0, 1)}
    per = per.withColumns({n + "_": s for n, s in sums.items()}).join(base, "part")
    edge = lambda k: (F.col("a0") + F.col(f"a{k}_") + (F.col("b0") + F.col(f"b{k}_")) * F.lit(level)) / F.lit(float(max(total, 1)))
    return per.select("skey", "source_size", "target", edge(1).alias("lo"), edge(0).alias("hi"))


def point(i: Column) -> Column:
    """frac((i + 1) * phi) without losing bits for large i."""
    n = i + 1
    x = F.pmod(F.shiftright(n, 24) * F.lit(PHI_24), F.lit(1.0)) + F.pmod(n.bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(PHI), F.lit(1.0))
    return F.pmod(x, F.lit(1.0))


def ranked_slots(slots: DataFrame, shares: DataFrame) -> DataFrame:
    """(i, skey, rank): slots of (i) dealt to sources and ranked from 0 in each."""
    n = shares.count()
    cells = max(CELLS, 4 * n)
    spans = shares.filter(F.col("hi") > F.col("lo")).select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1).cast("long"), F.floor(F.col("hi") * cells)))).alias("cell"))
    at = slots.withColumn("u", point(F.col("i"))).withColumn("cell", F.floor(F.col("u") * cells))
    dealt = at.join(spans, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    dealt = cut(dealt.select("i", "skey", F.floor(F.col("i") / (FAN * FAN)).alias("coarse"), F.floor(F.col("i") / FAN).alias("fine")), "mix-dealt")
    fine = dealt.groupBy("skey", "coarse", "fine").agg(F.count("*").alias("n"))
    fine = fine.withColumn("inner", F.coalesce(F.sum("n").over(_before("skey", "coarse").orderBy("fine")), F.lit(0)))
    fine = cut(fine, "mix-fine")
    coarse = fine.groupBy("skey", "coarse").agg(F.sum("n").alias("n")).withColumn("top", F.floor(F.col("coarse") / FAN))
    tops = coarse.groupBy("skey", "top").agg(F.sum("n").alias("n")).select("skey", "top", F.coalesce(F.sum("n").over(_before("skey").orderBy("top")), F.lit(0)).alias("outer"))
    coarse = coarse.select("skey", "coarse", "top", F.coalesce(F.sum("n").over(_before("skey", "top").orderBy("coarse")), F.lit(0)).alias("middle"))
    base = cut(coarse.join(tops, ["skey", "top"]).select("skey", "coarse", (F.col("outer") + F.col("middle")).alias("before")), "mix-bases")
    base = fine.join(base, ["skey", "coarse"]).select("skey", "fine", (F.col("before") + F.col("inner")).alias("before"))
    own = F.row_number().over(Window.partitionBy("skey", "fine").orderBy("i")) - 1
    return dealt.withColumn("own", own).join(base, ["skey", "fine"]).select("i", "skey", (F.col("before") + F.col("own")).alias("rank"))


def laid_out(sizes: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """``sizes`` with source_size, target, slots and off, each document's first word's
    place in its source's shuffled order."""
    h = F.xxhash64(F.lit(seed), F.col("id"))
    d = sizes.withColumn("h", h).withColumn("fine", F.pmod("h", F.lit(FAN * FAN)).cast("int")).withColumn("coarse", F.floor(F.col("fine") / FAN).cast("int"))
    fine = d.groupBy("skey", "coarse", "fine").agg(F.sum("size").alias("n"))
    fine = cut(fine.withColumn("inner", F.coalesce(F.sum("n").over(_before("skey", "coarse").orderBy("fine")), F.lit(0))), "mix-buckets")
    coarse = fine.groupBy("skey", "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.select("skey", "coarse", F.coalesce(F.sum("n").over(_before("skey").orderBy("coarse")), F.lit(0)).alias("before"))
    base = cut(fine.join(coarse, ["skey", "coarse"]).select("skey", "fine", (F.col("before") + F.col("inner")).alias("before")), "mix-starts")
    own = F.coalesce(F.sum("size").over(_before("skey", "fine").orderBy("h", "id", "size")), F.lit(0))
    placed = d.withColumn("own", own).join(base, ["skey", "fine"]).join(shares.select("skey", "source_size", "target", "slots"), "skey")
    return placed.select("id", "skey", "size", "source_size", "target", "slots", (F.col("before") + F.col("own")).alias("off"))


def sequence(placed: DataFrame, ranked: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(i, id, skey, off, pass, from_word, to_word): what each slot takes, in the
    order of the mix: words [from_word, to_word) of a document, in a pass over its
    source. Slots after the schedule, of sources without a point, have no i."""
    q, r, rank = F.expr("goal div slots"), F.col("goal") % F.col("slots"), F.col("rank")
    d = placed.filter(F.col("size") > 0).withColumn("goal", F.floor(F.col("target") + 0.5)).withColumns({"q": q, "r": r})
    d = d.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("start", F.col("off") + F.col("pass") * F.col("source_size"))
    d = d.withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("goal"))).filter("start < stop")
    # Of a source's blocks the first r have q + 1 words and the others q.
    long = F.col("r") * (F.col("q") + 1)
    block_of = lambda word: F.when(word < long, F.floor(word / (F.col("q") + 1))).otherwise(F.col("r") + F.floor((word - long) / F.col("q")))
    d = d.withColumn("rank", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("stop") - 1))))
    edge = lambda k: k * F.col("q") + F.least(k, F.col("r"))
    d = d.withColumn("a", F.greatest(edge(rank), F.col("start"))).withColumn("b", F.least(edge(rank + 1), F.col("stop")))
    d = d.select("id", "skey", "off", "pass", "rank", (F.col("a") - F.col("start")).alias("from_word"), (F.col("b") - F.col("start")).alias("to_word"))
    return d.join(ranked, ["skey", "rank"], "left").select("i", "id", "skey", "off", "pass", "from_word", "to_word")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """(id_col, size, source_size, target, taken) per row of ``docs``.

    Size is the number of words (null text: 0, taken 0); taken counts the words
    that the slots of the schedule take from the document, repeats included, at
    most ``max_repeats`` times its size. Each source's taken words are its target,
    rounded. Reruns agree: the order is by a seeded hash of the id, ties by id and
    size. Rows that repeat an id are rows of their own; rows of one id and size
    share what they take evenly enough that their sum is right. A null source is a
    source. An empty table gives no rows. Other columns of ``docs`` are ignored.
    Texts are read once; ``sequence`` gives the mix itself, slot by slot.
    """
    placed, ranked = schedule(docs, id_col, text_col, source_col, block, weights, max_repeats, seed)
    taken = sequence(placed, ranked, max_repeats).groupBy("skey", "off").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    taken = cut(taken.withColumnRenamed("skey", "k").withColumnRenamed("off", "o"), "mix-taken")
    out = placed.join(taken, (F.col("skey") == F.col("k")) & (F.col("off") == F.col("o")) & (F.col("size") > 0), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(placed, ranked): documents laid out in their sources, and ranked slots."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = cut(sizes.withColumn("skey", source_key(F.col("source"))), "mix-sizes")
    shares = cut(targets(sizes, weights, max_repeats), "mix-shares")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    slots = docs.sparkSession.range(0, -(-total // block)).withColumnRenamed("id", "i")
    ranked = cut(ranked_slots(slots, shares), "mix-slots")
    dealt = ranked.groupBy("skey").agg((F.max("rank") + 1).alias("slots"))
    shares = cut(shares.join(dealt, "skey", "left").withColumn("slots", F.coalesce("slots", F.lit(1))), "mix-dealt-shares")
    return cut(laid_out(sizes.drop("source"), shares, seed), "mix-placed"), ranked

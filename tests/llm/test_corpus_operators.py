"""Operators over corpora against brute force: 1, 3, 5, 7, 9 and the pipeline."""

import collections
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, ngram_join, suffix_dedup, topk, toxicity
from quire.llm.components import components
from quire.llm.shingles import grams, mixed, runs, shingle_sets


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def words_of(text):
    return (text or "").encode().lower().split()


def linked(nodes, links):
    """{node: smallest node reachable}."""
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


# --- n-gram Jaccard join -------------------------------------------------------


def naive_rows(docs, k=3, percent=90):
    """(id, size, component_id) of rows whose ids may be null or repeat."""
    place = {n: (n, t) for n, (_, t) in enumerate(docs)}
    found = naive_components(place.values(), k, percent)
    least = {}
    for n, (i, _) in enumerate(docs):
        if i is not None:
            least[found[n][1]] = min(i, least.get(found[n][1], i))
    return sorted(((i, found[n][0], least.get(found[n][1])) for n, (i, _) in enumerate(docs)), key=repr)


def naive_components(docs, k=3, percent=90):
    sets = {}
    for i, t in docs:
        w = words_of(t)
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), [linked(sets, links)[i] for i in sets])}


def families(seed, n):
    """Documents in families of near copies, with a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(15)]
    docs = []
    while len(docs) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(2, 160))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = shared
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_sets(spark, odd, seed):
    docs = families(seed, 220)
    got = ngram_join.similar_sets(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == naive_components(docs)


def test_similar_sets_of_odd_rows(odd, none):
    got = ngram_join.similar_sets(odd)
    rows = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got.collect()}
    assert got.count() == odd.count()
    assert rows[(11, 3)] == 11 and rows[(12, 3)] == 11 and rows[(5, 0)] == 5 and rows[(6, 0)] == 6
    assert {rows[k] for k in rows if k[0] in (9, 10)} == {9}
    assert ngram_join.similar_sets(none).count() == 0


def test_similar_sets_of_repeated_and_missing_ids(spark):
    rng = random.Random(8)
    docs = [(rng.choice([None, None, i, i % 7, i % 30]), t) for i, t in families(6, 160)]
    docs += [(900, None), (None, ""), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = ngram_join.similar_sets(df)
    assert pairs(got, "doc_id", "n_shingles", "component_id") == naive_rows(docs)
    words = [f"w{k}" for k in range(60)]
    z, t = [f"z{k}" for k in range(60)], [f"t{k}" for k in range(60)]
    change = lambda w: " ".join([*w[:-1], "x"])
    docs = [(1, " ".join(words)), (None, change(words)), (7, " ".join(z)), (7, " ".join(t)), (3, change(z)), (2, change(t))]
    got = pairs(ngram_join.similar_sets(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == naive_rows(docs) == sorted([(1, 58, 1), (None, 58, 1), (7, 58, 3), (7, 58, 2), (3, 58, 3), (2, 58, 2)], key=repr)


def test_filters_lose_no_link(spark):
    docs = families(3, 60)
    frame = spark.createDataFrame([(i, i, t) for i, t in docs], "id long, rk long, text string")
    h = ngram_join.heads(frame, 3, 90).filter("token is null").filter("n > 0").withColumn("rk", F.col("id")).withColumn("key", F.col("id")).persist()
    sets = dict(zip([i for i, _ in docs], shingle_sets([t for _, t in docs], 3)))
    every = h.select(F.col("key").alias("a")).join(h.select(F.col("key").alias("b")), F.col("a") < F.col("b"))
    passed = {(r["a"], r["b"]) for r in ngram_join.in_all_orders(every, h, 90).collect()}
    spoken = {r["id"] for r in h.filter("sketch is not null").collect()}
    pairs_left = ngram_join.in_all_orders(every, h, 90).filter(F.col("a").isin(*spoken) & F.col("b").isin(*spoken))
    kept = {(r["a"], r["b"]) for r in ngram_join.sieved(pairs_left, h.filter("sketch is not null").select("rk", "siga", "sigb", "n", "sketch"), 90).collect()}
    passed = {p for p in passed if p in kept or not {*p} <= spoken}
    ids = sorted(i for i in sets if len(sets[i]))
    for a in ids:
        for b in (b for b in ids if b > a):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 100 * c >= 90 * (len(sets[a]) + len(sets[b]) - c):
                assert (a, b) in passed


def test_components_like_search(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = linked({n for x in links for n in x}, links)
    assert got == {n: c for n, c in want.items() if any(n in x and x[0] != x[1] for x in links)}


# --- repeated passages -----------------------------------------------------------


def test_passages(spark):
    rng = random.Random(2)
    fresh = iter(range(10**6))
    word = lambda: f"u{next(fresh)}"
    passages = [[f"p{k}_{j}" for j in range(n)] for k, n in enumerate((50, 51, 60, 75, 120, 300))]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((i, " ".join(w)))
    docs += [(100, docs[0][1].upper()), (101, " ".join(f"p5_{j}" for j in range(49)))]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    texts = {i: words_of(t) for i, t in docs}
    holders = collections.defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    several = [v for v in holders.values() if len(v) > 1]
    assert {r["doc_id"] for r in got} == set().union(*several)
    for r in got:
        n = r["end_word"] - r["start_word"]
        a, b = texts[r["doc_id"]], texts[r["other_id"]]
        assert n >= 50 and a[r["start_word"] : r["end_word"]] == b[r["other_start"] : r["other_start"] + n]
        assert r["start_word"] == 0 or r["other_start"] == 0 or a[r["start_word"] - 1] != b[r["other_start"] - 1]
    reach = linked({r["doc_id"] for r in got}, [(r["doc_id"], r["other_id"]) for r in got])
    assert all(len({reach[i] for i in v}) == 1 for v in several)


def test_minimisers_and_runs_like_loops():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 3, 25, 26, 60, 200)]
    size = [len(d) for d in docs]
    flat = np.concatenate(docs)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    want = []
    for first, d in zip(np.cumsum([0, *size]), docs):
        h = mixed(grams(d, 8), 40) | np.uint64(1)
        found = {k for j in range(len(h) - 17) for k in range(j, j + 18) if h[k] == h[j : j + 18].min()}
        want += sorted(first + k for k in found)
    assert suffix_dedup.picked(flat, left, 8, 18).tolist() == want
    for k in (1, 2, 33, 50):
        h = runs(flat, k)
        same = {}
        for i, x in enumerate(h.tolist()):
            same.setdefault(x, set()).add(tuple(flat[i : i + k].tolist()))
        assert all(len(v) == 1 for v in same.values()) and len(same) == len({v for s in same.values() for v in s})


def test_every_place_of_a_passage_has_a_row(spark):
    rng = random.Random(5)
    fresh = iter(range(10**6))
    base = [f"b{j}" for j in range(90)]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(1, 4)):
            p = list(base[rng.randint(0, 25) : rng.randint(65, 90)])
            if rng.random() < 0.5:
                p[rng.choice([3, 20, len(p) - 12, len(p) - 3])] = rng.choice("xy")
            w += p + [f"u{next(fresh)}" for _ in range(rng.randint(0, 30))]
        docs.append((i, " ".join(w)))
    alone = [f"s{j}" for j in range(70)]
    docs += [(200, " ".join([*alone, "z", *alone, *alone])), (201, "again " * 120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = suffix_dedup.repeated_passages(df)
    texts, places = {i: words_of(t) for i, t in docs}, collections.defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].add((i, k))
    spans = collections.defaultdict(list)
    for r in got.collect():
        n = r["end_word"] - r["start_word"]
        assert (r["doc_id"], r["start_word"]) != (r["other_id"], r["other_start"])
        assert n >= 50 and texts[r["doc_id"]][r["start_word"] : r["end_word"]] == texts[r["other_id"]][r["other_start"] : r["other_start"] + n]
        spans[r["doc_id"]].append((r["start_word"], r["end_word"]))
    lost = [(i, k) for v in places.values() if len(v) > 1 for i, k in v if not any(a <= k and k + 50 <= b for a, b in spans[i])]
    assert not lost
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(df, got).collect()}
    assert left[200] == " ".join([*alone, "z"]) and left[201] == "again"
    kept = [tuple(w[k : k + 50]) for t in left.values() for w in [words_of(t)] for k in range(len(w) - 49)]
    assert len(kept) == len(set(kept))


def test_passages_of_odd_rows(odd, none):
    got = suffix_dedup.repeated_passages(odd)
    assert {r["doc_id"] for r in got.collect()} == {9, 10}
    left = suffix_dedup.drop_repeats(odd, got)
    assert left.columns == odd.columns and {r["text"] for r in left.filter("doc_id = 10").collect()} == {"end"}
    assert suffix_dedup.repeated_passages(none).count() == 0


# --- top-k -----------------------------------------------------------------------


def naive_top(rows, k):
    q = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in q:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in q if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("scale,dims", [(1.0, 8), (0.01, 3), (9000.0, 4)])
def test_top_k(spark, scale, dims, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 90)
    monkeypatch.setattr(topk, "GROUP", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dims) * scale]) for i in range(1, 260)]
    same = rows[6][1]
    rows = [(i, same if i % 9 == 0 else v) for i, v in rows] + [(300, None), (350, [1.0, None] * (dims // 2)), (400, [float("nan")] * dims), (None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).repartition(4)
    assert pairs(topk.top_k(df), "query_id", "rank", "vec_id", "score") == naive_top(rows, 5)


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(50, [1.0])], schema)).count() == 0
    assert pairs(topk.top_k(spark.createDataFrame([(50, [1.0]), (3, [-2.0])], schema)), "query_id", "rank", "vec_id", "score") == [(50, 1, 3, -131072)]


def test_top_k_of_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(50, [0.0, 1.0]), (3, [2.0**45, 1.0]), (4, [0.5, 0.5]), (100, [-1e300, 2.0]), (5, [1e300, -3.0]), (6, [1e308, 0.25]), (150, [1e-300, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, schema).repartition(3)).collect()
    whole = {i: [int(x) * 256 if abs(x) >= 2.0**53 else int(np.floor(x * 256)) for x in v] for i, v in rows}
    want = []
    for q in (50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, min(max(-s, topk.LEAST), topk.MOST)) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert (50, 3, 3, 65536) in want


# --- language and toxicity -------------------------------------------------------

SYLLABLES = {"en": "the and ing tion er".split(), "de": "der ung sch ein ü".split(), "fr": "le que é eau oi".split(), "es": "el os ció ñ ar".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_language(spark, odd, none):
    rng = random.Random(1)
    rows = [(k, speech(rng, lang, rng.randint(5, 60)), lang) for k in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, "doc_id", "text", "lang", F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [(lang, got[k]["lang_pred"]) for k, _, lang in rows if k % 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    und = {r["doc_id"] for r in langid.identify(odd, model).filter("lang_pred = 'und'").collect()}
    assert {5, 6, 7, 8, 17} <= und and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none, "doc_id", "text", "lang", F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_codewords_stand_apart():
    for n in range(2, 40):
        code = langid.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2)


def test_decoding_survives_a_wrong_bit():
    m = langid.Model.__new__(langid.Model)
    m.langs, m.code = ["a", "b", "c", "d"], langid.codewords(4)
    m.weight, m.w = np.ones(7), np.zeros((langid.BUCKETS, 7), np.float32)
    for k, word in enumerate(m.code):
        for wrong in range(7):
            margin = 3.0 * word
            margin[wrong] *= -1
            m.b = margin.astype(np.float32)
            assert m.decode(np.zeros(langid.BUCKETS, np.float32))[0] == m.langs[k]


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(7)
    bad, docs, labels = ["idiot", "moron", "pathetic"], [], []
    for k in range(500):
        w = speech(rng, "en", 40).split()
        if k % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 5 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 2 == 0)


@pytest.mark.parametrize("seen,want", [("1d10t", "idiot"), ("m0r0n", "moron"), ("mooooron", "moron"), ("i d i o t", "idiot"), ("p.a.t.h.e.t.i.c", "pathetic"), ("path3t!c", "pathetic"), ("p@thetic", "pathetic"), ("i  d  i  o  t", "idiot"), ("i\nd\tio\nt", "idiot"), ("id iot", "idiot"), ("iiddiioott", "idiot"), ("mo'ro'n", "moron"), ("(1d10t!!!", "idiot"), ("m" + "o" * 500 + "ron", "moron")])
def test_restores(talk, seen, want):
    assert toxicity.Reader(talk[2].chars).restored(" ".join(toxicity.bare(seen).split())) == want
    plain = "theing ander tioner " * 3
    assert talk[2].score(plain + f"{seen} {seen} {seen}") >= 0.5 > talk[2].score(plain)


def test_viterbi_like_every_path(talk):
    model = talk[2].chars.astype(np.float64)
    rng = random.Random(3)

    def total(path):
        a = b = 0
        cost = 0.0
        for out, c in path:
            cost -= c
            if out:
                k = toxicity.CLASS_OF.get(out, 1)
                cost += model[a, b, k]
                a, b = b, k
        return cost + model[a, b, 0]

    for _ in range(150):
        seen = "".join(rng.choices("aidot1003@.' eé!", k=rng.randint(1, 7)))
        paths = [(total(p), "".join(out for out, _ in p)) for p in itertools.product(*toxicity.ways(seen))]
        best = max(paths)[0]
        assert toxicity.restore(seen, model.tolist()) in {t for v, t in paths if v > best - 1e-9}, seen


def test_any_text_is_scored_in_linear_time(talk):
    million = 1_000_000
    texts = ["ab" * (million // 2), "a" * million, "漢字仮名交文" * (million // 6), "." * million + "a", "a b " * (million // 40), "!" * million, ("x" + " " * 999) * 1000, "a." * (million // 20)]
    talk[2].score("warm up")
    for t in texts:
        began = time.perf_counter()
        assert talk[2].score(t) < 0.5
        assert time.perf_counter() - began < 1.0, t[:10]


def test_toxicity(talk, odd, none, spark):
    docs, labels, model = talk
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sum(got[k] == int(k % 5 == 0) for k in got if k % 2) >= 0.98 * 250
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in scores)
    assert toxicity.score(none, model).count() == 0
    alone = toxicity.fit(docs, labels.filter("toxic = 0"), F.lit(True))
    assert {r["score"] < 1e-6 for r in toxicity.score(docs, alone).collect()} == {True}
    assert toxicity.fit(none, labels, F.lit(True)).score("x") < 1e-6


def test_logistic_weighs_both_labels():
    w, b = toxicity.logistic([[0], [0, 1], [1], [1], [], []], np.array([1, 1, 0, 0, 0, 0]), 2)
    assert w[0] > 1 > abs(w[1]) and b < 0


# --- pipeline and registration ---------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    from quire.llm.common import cut, table
    from quire.llm.tokens import encoder

    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in cp.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf), name)
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == list(cp.COLUMNS) == list(before.columns)
    source = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    toxic = {r["doc_id"] for r in table(spark, sf, "labels").filter("toxic = 1").collect()}
    assert all(source[r["doc_id"]] == r for r in kept["toxicity"])
    assert len(kept["line_dedup"]) == len(kept["toxicity"]) and all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    comps = naive_components([(r["doc_id"], r["text"]) for r in kept["line_dedup"]], 5, 80)
    assert sorted(r["doc_id"] for r in kept["ngram_jaccard_join"]) == sorted(i for i, (_, c) in comps.items() if i == c)
    times = collections.Counter(r["doc_id"] for r in kept["mix_sources"])
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in kept["ngram_jaccard_join"]}
    texts = {r["doc_id"]: r["text"] for r in kept["ngram_jaccard_join"]}
    tok = encoder(cp.default_vocabulary()).tok
    assert len(kept["bpe"]) == len(kept["mix_sources"])
    assert all(list(r["ids"]) == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in kept["bpe"])
    assert toxic


def test_pipeline_stages_take_odd_rows(odd, spark, sf):
    import corpus_pipeline as cp

    from quire.llm.common import cut

    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in cp.STAGES:
            docs = cut(stage(spark, docs, sf), name)
        assert (docs.count() > 0) == (rows.count() > 0)


def test_one_of_each_group_stays(spark, sf):
    import corpus_pipeline as cp

    rng = random.Random(4)
    docs = [(rng.choice([None, i, i, i % 9]), t, "en", None, len(t)) for i, t in families(11, 140)]
    docs += [docs[0], docs[0], docs[3], (None, docs[5][1], "de", "s", 1), (None, docs[5][1], "de", "r", 1), (70, None, None, None, None), (70, None, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [tuple(r) for r in cp.near_copies(spark, df, sf).collect()]
    found = naive_components(list(enumerate(d[1] for d in docs)), 5, 80)
    groups = collections.defaultdict(list)
    for n, (size, c) in found.items():
        if size:
            groups[c].append(docs[n])
    assert len(kept) == len(groups) + 2 and not set(kept) - set(docs)
    place = {d: c for n, (size, c) in found.items() for d in [docs[n]] if size}
    seen = [place[d] for d in kept if d[1]]
    assert sorted(seen) == sorted(groups)
    for d in kept:
        if d[1]:
            ids = [x[0] for x in groups[place[d]] if x[0] is not None]
            assert d[0] == (min(ids) if ids else None)


def test_folds_and_names(spark):
    import __spark_entry__ as entry
    from quire.llm.queries import fold

    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", fold(5).alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows.collect())
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_cut_starts_no_process_for_a_file(spark):
    """Until a process has become chmod it counts as much memory as its JVM."""
    from pathlib import Path

    from quire.llm import common

    def started():
        return int(next(x for x in Path("/proc/stat").read_text().splitlines() if x.startswith("processes")).split()[1])

    common.cut(spark.range(0, 100, 1, 4), "first")  # compiles the file system
    grown = []
    for _ in range(3):  # the machine's other processes count too
        before = started()
        out = common.cut(spark.range(0, 1000, 1, 48), "files")
        grown.append(started() - before)
    assert min(grown) < 48
    files = sorted(Path(common._PATHS[out].removeprefix("file:")).iterdir())
    assert len(files) == 49 and not any(f.suffix == ".crc" for f in files)
    assert {f.stat().st_mode & 0o777 for f in files} == {0o644}  # Hadoop's own mask is 022
    assert out.agg({"id": "sum"}).first()[0] == 499_500
    common.discard(out)
    assert not files[0].exists()


def test_writes_of_a_caller_keep_their_files(spark, tmp_path):
    from pathlib import Path

    from quire.llm import common

    common.cut(spark.range(0, 100, 1, 4), "first")
    count = lambda: int(next(x for x in Path("/proc/stat").read_text().splitlines() if x.startswith("processes")).split()[1])
    grown = []
    for n in range(3):
        before = count()
        spark.range(0, 1000, 1, 48).write.parquet(f"file://{tmp_path}/{n}")
        grown.append(count() - before)
    assert min(grown) < 48
    files = [f for f in (tmp_path / "2").iterdir() if f.suffix != ".crc"]
    assert len(files) == 49 and all((f.parent / f".{f.name}.crc").exists() and f.stat().st_mode & 0o777 == 0o644 for f in files)
    assert spark.read.parquet(f"file://{tmp_path}/2").count() == 1000


def test_cut_leaves_no_shuffle_files(spark):
    from quire.llm import common

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def blocks():
        found = disk.getAllBlocks()
        return {b.name() for b in map(found.apply, range(found.size())) if b.isShuffle()}

    df = spark.range(0, 10_000, 1, 4).groupBy((F.col("id") % 1000).alias("k")).count()  # made before the setting changes
    before = blocks()
    out = common.cut(df, "counted")
    until = time.time() + 20
    while blocks() - before and time.time() < until:  # deleted in the background
        time.sleep(0.2)
    assert not blocks() - before
    assert out.count() == 1000 and spark.conf.get(common.SHUFFLES_GO) == "false"
    assert common.cut(df, "again").count() == 1000


def test_crowded_tokens_meet_few_first(spark, monkeypatch):
    """A chain of near copies joins one family by few comparisons, round by round."""
    dice = random.Random(5)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for n in range(500):
        words = list(base)
        words[dice.randrange(140)] = f"own{n}"
        words[dice.randrange(140)] = f"other{n}"
        rows.append((n, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met, usual = [], ngram_join._candidates

    def candidates(posts, percent, few):
        found = usual(posts, percent, few)
        met.append((few, found.count()))
        return found

    monkeypatch.setattr(ngram_join, "_candidates", candidates)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_sets(docs, k=3, percent=90).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(138)} for _, t in rows]
    want = list(range(500))
    for i, j in itertools.combinations(range(500), 2):
        if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
            a, b = sorted((want[i], want[j]))
            if a != b:
                want = [a if x == b else x for x in want]
    assert got == dict(enumerate(want))
    assert sum(n for _, n in met) < 500 * 20

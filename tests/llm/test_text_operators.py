"""Operators on single texts against plain code: 2, 4, 6, 8, 10."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, quality, token_files, tokens
from quire.llm.line_dedup import dedup_lines

WS = " \t\n\x0b\x0c\r"
VOCABULARY = tokens.default_vocabulary()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def ids(text):
    return tokens.encoder(VOCABULARY).tok.encode(text or "", add_special_tokens=False).ids


def test_round_trip(odd):
    want = sorted(((r["doc_id"], len(ids(r["text"])), sha(",".join(map(str, ids(r["text"])))), sha(r["text"] or "")) for r in odd.collect()), key=repr)
    got = bpe.round_trip(odd, VOCABULARY)
    assert pairs(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode(bpe.encode(odd, VOCABULARY), VOCABULARY)
    assert pairs(back, "doc_id", "text") == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=repr)


@pytest.mark.parametrize("bits", [2, 4, 9])
def test_chunks_join_exactly(monkeypatch, bits):
    monkeypatch.setattr(bpe, "BITS", bits)
    enc = bpe.ChunkEncoder(tokens.encoder(VOCABULARY), keep=50)
    rng = random.Random(bits)
    signs = [*"abcXYZ  \n\t\r  ''stredvml0123²½!?.,;#<|>éßñ\x1c\x85\xa0漢字", "'ll", "'re", "<|endoftext|>", "😀", " œ"]
    for _ in range(400):
        text = "".join(rng.choices(signs, k=rng.randint(0, 150)))
        assert enc.encode(text) == ids(text), text
        assert tokens.encoder(VOCABULARY).encode(text) == ids(text), text


def test_shared_passages_are_encoded_once():
    enc = bpe.ChunkEncoder(tokens.encoder(VOCABULARY))
    words = [f"word{k * 7919 % 1000}" for k in range(3000)]
    enc.encode(" ".join(words))
    first = enc.misses
    enc.encode("other start " + " ".join(words))
    assert enc.misses - first <= 3 and enc.hits >= first - 3


def test_token_files(odd, none, spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    manifest = token_files.write(odd, path, VOCABULARY)
    want, at = [], 0
    for i, text in sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        t = [*ids(text), 0]
        want.append((i, at, len(t), zlib.crc32(np.array(t, dtype="<u4").tobytes())))
        at += len(t)
    got = token_files.read(spark, path, with_ids=True)
    assert pairs(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert sum(m["n_tokens"] for m in manifest) == at and [m["base"] for m in manifest][0] == 0
    raw = np.fromfile(f"{tmp_path}/tokens/{manifest[0]['name']}.bin", dtype=manifest[0]["dtype"])
    assert len(raw) == manifest[0]["n_tokens"]
    token_files.write(none, f"file://{tmp_path}/none", VOCABULARY)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def naive_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    hit = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(odd, none):
    got = quality.apply_rules(odd)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert pairs(got, "doc_id", *columns) == sorted(((r["doc_id"], *naive_counts(r["text"])) for r in odd.collect()), key=repr)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (r["first_failed"] is None)
    assert quality.apply_rules(none).count() == 0


def test_characters_beyond_ascii_are_one_letter_each():
    assert quality.few_letters(quality.Text("ab123456 ü 。。")) and not quality.few_letters(quality.Text("abcd12 漢字 。。"))


def test_files_that_cannot_be_mapped(odd, spark, tmp_path, monkeypatch):
    from pyarrow import fs

    path = f"file://{tmp_path}/tokens"
    token_files.write(odd, path, VOCABULARY)
    want = sorted(token_files.read(spark, path, with_ids=True).collect(), key=repr)

    class Other(fs.SubTreeFileSystem):
        pass

    system, root = token_files._fs(path)
    m = token_files.read_manifest(path)[0]
    other = Other("/", fs.LocalFileSystem())
    for kind, dtype in (("bin", m["dtype"]), ("idx", "<i8"), ("doc", "<i8")):
        a, b = (token_files._Numbers(x, f"{root}/{m['name']}.{kind}", dtype) for x in (system, other))
        assert b.mapped is None and a.size == b.size and (a[slice(1, a.size)] == b[slice(1, b.size)]).all()
    monkeypatch.setattr(token_files, "READ", 64)
    monkeypatch.setattr(token_files, "ROWS", 3)
    assert sorted(token_files.read(spark, path, with_ids=True).collect(), key=repr) == want


def test_repeat_words_like_windows():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        assert quality.repeat_words([w.encode() for w in words]) == naive_counts(" ".join(words))[4]


def test_order_by_rejections_per_second():
    measured = {"a": (1.0, 0.5), "b": (0.1, 0.4), "c": (0.1, 0.0)}
    assert quality.cascade_order(measured, dict.fromkeys("abc")) == ["b", "a", "c"]


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def naive_lines(docs):
    held, largest = collections.defaultdict(set), {}
    for i, t in docs:
        for k in {line_key(x) for x in t.split("\n")}:
            held[k].add(i)
            largest[k] = max(largest.get(k, -1), -1 if i is None else i)
    want = []
    for i, t in docs:
        lines = t.split("\n")
        kept = [x for x in lines if not (len(line_key(x)) >= 20 and len(held[line_key(x)]) >= 3 and largest[line_key(x)] != (-1 if i is None else i))]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(want, key=repr)


def test_lines(odd, none):
    got, want = dedup_lines(odd), naive_lines([(r["doc_id"], r["text"] or "") for r in odd.collect()])
    assert pairs(got, "doc_id", "n_lines", "n_dropped", "text") == want
    assert {r["_row"] for r in got.collect()} == {"r"} and dedup_lines(none).count() == 0
    assert any(n for _, _, n, _ in want)


def test_lines_of_repeated_and_missing_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quire.llm import queries

    x, y = "a line of text that is shared", "another line that some hold"
    docs = [(5, f"{x}\nown"), (5, f"{x}\nother"), (5, x), (9, f"{x}\n{y}"), (None, f"{y}\n{y}"), (None, f"{y}\nz"), (7, f"{y}\n"), (8, None), (7, y)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert pairs(dedup_lines(df), "doc_id", "n_lines", "n_dropped", "text") == naive_lines([(i, t or "") for i, t in docs])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    other = duckdb.connect()
    other.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    found = other.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP6_SQL})").fetchall()
    assert sorted(found, key=repr) == pairs(queries.op6_line_dedup(spark, str(tmp_path)), *columns)


def test_long_texts_lose_lines_in_linear_time(spark):
    lines = [f"line number {k} is long enough to count" for k in range(40_000)]
    docs = spark.createDataFrame([(k, "\n".join(lines)) for k in range(3)], "doc_id long, text string")
    began = time.perf_counter()
    assert pairs(dedup_lines(docs), "doc_id", "n_dropped") == [(0, 40_000), (1, 40_000), (2, 0)]
    assert time.perf_counter() - began < 20


def test_targets_like_resharing(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 100, 3000]) for k in range(rng.randint(1, 9))}
        names = sorted(sizes)
        weight = {n: 1 + k % 3 for k, n in enumerate(names)}
        total, want, active = sum(sizes.values()), {}, set(names)
        while active:
            left = total - sum(want.values())
            share = {n: left * weight[n] / sum(weight[a] for a in active) for n in active}
            over = [n for n in active if share[n] > 3 * sizes[n]]
            if not over:
                want |= share
                break
            for n in over:
                want[n] = 3.0 * sizes[n]
                active.discard(n)
        df = spark.createDataFrame([(f"s{n}", n, v) for n, v in sizes.items()], "skey string, source string, size long")
        got = {r["skey"][1:]: r["target"] for r in mixing.targets(df).collect()}
        assert got == pytest.approx(want)


def test_mix(odd, none, spark):
    rows = [(k, " ".join(["w"] * (k % 90)), f"s{k % 7}" if k % 11 else None) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs, block=8).collect()
    again = mixing.mix(docs.repartition(2), block=8).collect()
    assert sorted(got) == sorted(again) and len(got) == 700
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == r["doc_id"] % 90 and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source_size"], r["target"]].append(r)
    for (size, target), rs in by.items():
        assert sum(r["size"] for r in rs) == size and abs(sum(r["taken"] for r in rs) - target) <= 0.5
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd).count() == odd.count()


def test_mix_of_sources_of_any_size(spark):
    sizes = [("a", 900), ("a", 8000), ("b", 7), ("b", 3), ("c", 5), (None, 1), ("d", 0)]
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes)]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    by = collections.defaultdict(int)
    for k, (s, _) in enumerate(sizes):
        by[s] += got[k]["taken"]
        assert got[k]["taken"] <= 3 * got[k]["size"]
    assert all(abs(by[s] - got[k]["target"]) <= 0.5 for k, (s, _) in enumerate(sizes))
    assert by["b"] == 30 and by["c"] == 15 and by[None] == 3 and by["a"] == 8868


def naive_mix(rows, block, seed_order):
    """{(slot or None, id, pass): [from, to)} of the schedule, word by word."""
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    size = {s: sum(n for _, n, x in rows if x == s) for s in sources}
    total, weight, target, active = sum(size.values()), {s: 1 + k % 3 for k, s in enumerate(sources)}, {}, list(sources)
    while active:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[a] for a in active) for s in active}
        over = [s for s in active if share[s] >= 3 * size[s]]
        target |= {s: 3.0 * size[s] for s in over} if over else share
        active = [s for s in active if s not in over] if over else []
    dealt, at = {s: [] for s in sources}, 0.0
    ends = []
    for s in sources:
        ends.append((at, at + target[s] / total, s))
        at += target[s] / total
    for i in range(-(-total // block)):
        u = ((i + 1) * mixing.PHI) % 1.0
        for lo, hi, s in ends:
            if lo <= u < hi:
                dealt[s].append(i)
    words = []
    for s in sources:
        stream = [(i, k) for i in seed_order[s] for k in range(dict((a, n) for a, n, _ in rows)[i])]
        goal, slots = int(target[s] + 0.5), max(1, len(dealt[s]))
        sizes = [goal // slots + (k < goal % slots) for k in range(slots)]
        slot_of = [k for k, n in enumerate(sizes) for _ in range(n)]
        words += [(dealt[s][slot_of[w]] if dealt[s] else None, *stream[w % len(stream)], w // len(stream)) for w in range(goal)]
    return collections.Counter(words)


def test_sequence_word_by_word(spark):
    rng = random.Random(12)
    rows = [(k, rng.randint(0, 40), rng.choice(["x", "y", "z", "q", None, "rare"][: 5 + (k == 7)])) for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(["w"] * n), s) for k, n, s in rows], "doc_id long, text string, source string").repartition(3)
    placed, ranked = mixing.schedule(docs, block=8)
    order = collections.defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: r["off"]):
        order[None if r["skey"] == "n" else r["skey"][1:]].append(r["id"])
    got = collections.Counter()
    for r in mixing.sequence(placed, ranked).collect():
        got.update((r["i"], r["id"], w, r["pass"]) for w in range(r["from_word"], r["to_word"]))
    assert got == naive_mix(rows, 8, order)


def test_points_cover_shares(spark):
    rows = spark.range(2000).select(mixing.point(F.col("id")).alias("u")).collect()
    hits = np.histogram([r["u"] for r in rows], bins=20, range=(0, 1))[0]
    assert hits.min() >= 97 and hits.max() <= 103

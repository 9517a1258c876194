"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed
character n-grams learns which half of the languages a text belongs to. Decoding
takes the codeword with the least loss over all bits, each bit weighted by how
well its classifier did in training; a near tie is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker

#: Hash buckets of n-grams, their lengths, rows to learn from (about, shared
#: equally among languages), rounds of gradient descent.
BUCKETS, LENGTHS, SAMPLE, ROUNDS = 4096, (1, 2, 3), 4000, 150
#: Bits for more languages than exhaustive codes serve.
RANDOM_BITS = 31
#: A lead of less than this (in loss) over the next language is ambiguous.
LEAD = 0.5

_LETTER = np.zeros(0, dtype=bool)


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)
    return _LETTER


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of n-gram frequencies (square roots); None without letters.

    Whole text, lower case, runs of other characters as one blank."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, 32).astype(np.uint32)
    c = c[np.concatenate([[True], letter[1:] | letter[:-1]])]
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.float64)
    h = np.zeros(len(c), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(1, max(LENGTHS) + 1):
            n = len(c) - k + 1
            if n <= 0:
                break
            h = (h[:n] * np.uint32(0x01000193)) ^ (c[k - 1 : k - 1 + n] * np.uint32(0x9E3779B1))
            if k in LENGTHS:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                out += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of +-1 per language: all distinct splits up to 6 languages, and
    seeded random splits, distinct and not constant, beyond."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.int64)
    if n <= 6:
        splits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, dtype=np.int64).T
    rng = np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], size=(n, max(RANDOM_BITS, 2 * n.bit_length() + 8)))
        code = code[:, np.abs(code.sum(axis=1 - 1)) < n]
        gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if gap > apart:
            best, apart = code, gap
    return best


class Model:
    """Languages, codewords, classifiers and bit weights."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        bits = self.code.shape[1]
        self.w, self.b, self.weight = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits)
        if bits:
            self._fit(x, self.code[y].astype(np.float32))

    def _fit(self, x: np.ndarray, t: np.ndarray) -> None:
        """Logistic regression of all bits at once, by accelerated descent."""
        n = len(x)
        w, b, rate, penalty = self.w, self.b, 8.0, 1e-5
        last_w, last_b = w.copy(), b.copy()
        for r in range(ROUNDS):
            push = r / (r + 3)
            w_at, b_at = w + push * (w - last_w), b + push * (b - last_b)
            g = -t / (1 + np.exp(np.clip(t * (x @ w_at + b_at), -30, 30)))
            last_w, last_b = w, b
            w, b = w_at - rate * (x.T @ g / n + penalty * w_at), b_at - rate * 0.1 * g.mean(axis=0)
        self.w, self.b = w.astype(np.float32), b.astype(np.float32)
        right = ((x @ self.w + self.b) * t > 0).mean(axis=0)
        self.weight = np.log(np.clip(right, 0.5 + 1e-3, 1 - 1e-3) / (1 - np.clip(right, 0.5 + 1e-3, 1 - 1e-3)))
        self.weight = self.weight / self.weight.mean()

    def decode(self, x: np.ndarray) -> tuple[str, float, str | None, bool]:
        """(language, probability, next language, whether they are near)."""
        if len(self.langs) == 1:
            return self.langs[0], 1.0, None, False
        margin = (x @ self.w + self.b).astype(np.float64)
        loss = (self.weight * np.logaddexp(0.0, -self.code * margin)).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        p = np.exp(loss[order[0]] - loss)
        lead = float(loss[order[1]] - loss[order[0]])
        return self.langs[order[0]], float(p[order[0]] / p.sum()), self.langs[order[1]], lead < LEAD


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn, sample: int = SAMPLE) -> Model:
    """Learn from rows where ``learn`` holds and the language is known.

    At most about ``sample`` rows, equally many of each language, picked by a hash of the
    id. The driver gets a feature vector per picked row.
    """
    import pyarrow as pa

    known = docs.filter(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    counts = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64))
    share = max(1, sample // len(langs))
    grid = 1 << 30
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(grid, -(-grid * share // counts[lang])))])
    picked = known.filter(F.pmod(F.xxhash64(F.lit(23), F.col("_id")), F.lit(grid)) < rate[F.col("_lang")])
    place = {lang: k for k, lang in enumerate(langs)}

    @worker("none")
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist()):
                x = features(t.as_py())
                if x is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([place[lang]], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["y", "x"])

    rows = picked.select("_text", "_lang").mapInArrow(run, "y int, x binary").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(-1, BUCKETS)
    return Model(langs, x, rows["y"].to_numpy(dtype=np.int64))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, lang_pred, score, second, ambiguous.

    A null text, one without letters, or a model that has learned nothing gives
    und and score 0. Whole texts; rows that repeat stay; an empty table gives no
    rows; other columns are ignored. No shuffle.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @worker("none")
    def run(batches: Iterator) -> Iterator:
        m = shared.value
        for b in batches:
            out = []
            for t in b.column(1):
                x = features(t.as_py()) if m.langs else None
                out.append(("und", 0.0, None, False) if x is None else m.decode(x))
            kinds = (pa.string(), pa.float64(), pa.string(), pa.bool_())
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["_id", "lang_pred", "score", "second", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, lang_pred string, score double, second string, ambiguous boolean")
    return out.withColumnRenamed("_id", id_col)

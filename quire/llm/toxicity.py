"""Toxicity of texts after noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. What may be disguised
becomes a lattice: words that hold letters and a sign that the channel knows,
words with a letter three times in a row, or twice where the character model
finds them odd, letters that stand alone in a row whatever white space parts
them, and short neighbouring pieces that it finds odd. Each character may stand for itself, for a letter that it resembles, for a
repetition of the one before, or for nothing. Viterbi finds the likeliest letters
under the model and the channel's costs, in time linear in the text. Restored
words and their beginnings are the features of a logistic model.
"""

from __future__ import annotations

import math
import re
import weakref
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, holds_memory, worker

# The letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
# Characters that may be put between the letters of a word.
BETWEEN = ".-_*~'"
#: Costs of the channel, in nats.
COST_LEET, COST_REPEAT, COST_BETWEEN, COST_JOIN = 1.0, 0.5, 1.0, 0.3
#: Labelled rows that the model learns from, at most (the smallest id hashes).
SAMPLE = 8000
#: Features with weights; prefix lengths; most words in a worker's memo.
FEATURES, PREFIXES, MEMO = 1024, (4, 5, 6), 100_000
ROUNDS = 200
#: Least chi-square of a feature: a chance of one in a thousand.
SURE = 10.83

#: Classes of characters: 0 blank, 1 any other, then the letters.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
CLASSES = len(LETTERS) + 2
_CLASS = np.ones(0x110000, dtype=np.int32)
_CLASS[[ord(c) for c in LETTERS]] = np.arange(2, CLASSES)
_CLASS[[ord(c) for c in " \t\n\r\x0b\x0c"]] = 0
CLASS_OF = {c: k for k, c in enumerate(LETTERS, 2)} | {" ": 0}

#: Short pieces side by side; each pattern is linear in any text.
RUN = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3})+(?!\S)")
LETTER = re.compile(r"[^\W\d_]")
SIGN = re.compile("[" + re.escape("".join(LEET) + BETWEEN) + "]")
TWICE = re.compile(r"([^\W\d_])\1")
THRICE = re.compile(r"([^\W\d_])\1\1")
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
#: Punctuation around words.
OPENERS, CLOSERS = "\"'([{«¿¡", ".,;:!?\"')]}»…"
#: A word or piece is odd whose characters are less likely than the corpus's mean by so
#: many nats each.
ODD = 0.5


def codes(text: str) -> np.ndarray:
    """Trigrams of character classes, as single numbers."""
    c = _CLASS[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def char_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(code, n): trigrams of the whole corpus, summed in tasks first."""
    import pyarrow as pa

    @worker("toxicity")
    def run(batches: Iterator) -> Iterator:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    found = codes(t.as_py().lower())
                    if len(found) > 20_000:
                        total += np.bincount(found, minlength=CLASSES**3)
                    else:
                        np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["code", "n"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(counts) -> np.ndarray:
    """log P(c | a, b) from a frame of (code, n); a table of fixed size."""
    n = np.zeros(CLASSES**3)
    n[counts["code"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.float64)
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    single = n.sum(axis=(0, 1)) + 0.5
    double = n.sum(axis=0) + 5 * single / single.sum()
    double /= double.sum(axis=1, keepdims=True)
    triple = n + 5 * double[None]
    return np.log(triple / triple.sum(axis=2, keepdims=True)).astype(np.float32)


def ways(seen: str) -> Iterator[list[tuple[str, float]]]:
    """For each character what it may stand for, and at which cost."""
    before = ""
    for ch in seen:
        found = [(ch, 0.0)]
        if ch in LEET:
            found += [(x, COST_LEET) for x in LEET[ch]]
        if ch in BETWEEN:
            found.append(("", COST_BETWEEN))
        if ch == " ":
            found.append(("", COST_JOIN))
        elif ch == before:
            found.append(("", COST_REPEAT))
        yield found
        before = ch


def restore(seen: str, model) -> str:
    """The likeliest text behind a disguised one, by Viterbi over its lattice.

    ``model`` is log P(c | a, b) by a, b and c. A state is the last two classes;
    it points back to the state that it came from, and where one state is left
    what lies behind it is settled.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    settled: list[str] = []

    def settle(back: tuple | None) -> None:
        tail = []
        while back is not None:
            back, out = back
            tail.append(out)
        settled.extend(reversed(tail))

    for choices in ways(seen):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in best.items():
            row = model[a][b]
            for out, cost in choices:
                if out:
                    c = CLASS_OF.get(out, 1)
                    state, value = (b, c), score - cost + row[c]
                    if state not in after or value > after[state][0]:
                        after[state] = (value, (back, out))
                else:
                    value = score - cost
                    if (a, b) not in after or value > after[a, b][0]:
                        after[a, b] = (value, back)
        if len(after) == 1:
            ((state, (_, back)),) = after.items()
            settle(back)
            after = {state: (0.0, None)}
        best = after
    settle(max((score + model[a][b][0], k, back) for k, ((a, b), (score, back)) in enumerate(best.items()))[2])
    return "".join(settled)


def bare(word: str) -> str:
    """Without punctuation around it and runs of a symbol behind it."""
    end = len(word)
    while end:
        c = word[end - 1]
        if c in CLOSERS:
            end -= 1
            continue
        at = end
        if not (c.isalnum() or c == "_"):
            while at and word[at - 1] == c:
                at -= 1
        if end - at < 3:
            break
        end = at
    word = word[:end]
    inner = word.lstrip(OPENERS)
    return inner if inner[:1].isalnum() or inner[:1] == "_" else word


def word_features(word: str) -> set[int]:
    found = {zlib.crc32(("=" + word).encode("utf-8", "surrogatepass"))}
    found.update(zlib.crc32(("^" + word[:k]).encode("utf-8", "surrogatepass")) for k in PREFIXES if len(word) >= k)
    return found


_READERS: weakref.WeakSet = weakref.WeakSet()
holds_memory("toxicity", lambda: [r.clear() for r in _READERS])


class Reader:
    """Feature ids of texts; words are restored once per worker."""

    def __init__(self, model: np.ndarray, known: dict[int, int] | None = None):
        self.model, self.known = model.tolist(), known
        self.memo: dict[str, tuple[int, ...]] = {}
        self.oddness: dict[str, bool] = {}
        p = np.exp(model.astype(np.float64))
        flow = np.full((CLASSES, CLASSES), 1 / CLASSES**2)
        for _ in range(30):  # how often two classes meet, by the model itself
            flow = np.einsum("ab,abc->bc", flow, p)
        self.usual = float(np.einsum("ab,abc,abc->", flow, p, model))
        _READERS.add(self)

    def clear(self) -> None:
        self.memo.clear()
        self.oddness.clear()

    def _keep(self, restored: str) -> set[int]:
        found: set[int] = set()
        for w in restored.split():
            found |= word_features(w)
        return found if self.known is None else {self.known[f] for f in found if f in self.known}

    def _remember(self, seen: str, restored) -> tuple[int, ...]:
        got = self.memo.get(seen)
        if got is None:
            got = tuple(self._keep(restored(seen)))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(seen) <= 200:
                self.memo[seen] = got
        return got

    def restored(self, seen: str) -> str:
        """Runs of one character count as three, which changes no decision but
        how often it is repeated."""
        return restore(LONG_RUN.sub(r"\1\1\1", seen), self.model)

    def word(self, word: str) -> tuple[int, ...]:
        return self._remember(word, lambda seen: self.restored(w) if self.disguised(w := bare(seen)) else w)

    def disguised(self, word: str) -> bool:
        if (SIGN.search(word) and LETTER.search(word)) or THRICE.search(word):
            return True
        return bool(TWICE.search(word)) and self.odd(word)

    def odd(self, piece: str) -> bool:
        """One character, or less likely than usual, character by character."""
        got = self.oddness.get(piece)
        if got is None:
            a = b = 0
            total = 0.0
            for c in [CLASS_OF.get(ch, 1) for ch in piece] + [0]:
                total += self.model[a][b][c]
                a, b = b, c
            got = len(piece) == 1 or total / (len(piece) + 1) < self.usual - ODD
            if len(self.oddness) >= MEMO:
                self.oddness.clear()
            if len(piece) <= 200:
                self.oddness[piece] = got
        return got

    def pieces(self, parts: list[str]) -> Iterator[str]:
        """Neighbouring short pieces that may be one word: odd ones in a row, or
        an odd one with either neighbour."""
        odd = [self.odd(p) for p in parts]
        at = 0
        while at < len(parts):
            end = at
            while end < len(parts) and odd[end]:
                end += 1
            if end - at >= 2:
                if end - at >= 3 or any(len(p) > 1 for p in parts[at:end]):
                    yield " ".join(parts[at:end])
            elif end > at and len(parts[at]) > 1:
                if at:
                    yield " ".join(parts[at - 1 : end])
                if end < len(parts):
                    yield " ".join(parts[at : end + 1])
            at = max(end, at + 1)

    def features(self, text: str | None) -> list[int]:
        """Distinct features of the whole text."""
        low = (text or "").lower()
        found: set[int] = set()
        for w in set(low.split()):
            found.update(self.word(w))
        for m in RUN.finditer(low):
            for seen in self.pieces(m.group().split()):
                found.update(self._remember(seen, self.restored))
        return sorted(found)


class Model:
    """The character model, known features and their weights."""

    def __init__(self, chars: np.ndarray, known: dict[int, int], weights: np.ndarray, bias: float):
        self.chars, self.known, self.weights, self.bias = chars, known, weights, bias
        self._reader: Reader | None = None

    def __getstate__(self):
        return self.__dict__ | {"_reader": None}

    def score(self, text: str | None) -> float:
        if self._reader is None:
            self._reader = Reader(self.chars, self.known)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.weights[self._reader.features(text)].sum())))))


def logistic(rows: list[list[int]], y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias on binary features; both labels weigh the same in sum."""
    x = np.zeros((len(rows), size), dtype=np.float32)
    for r, row in zip(x, rows):
        r[row] = 1
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    t = np.where(y > 0, 1, -1).astype(np.float32)
    w, b, rate, penalty = np.zeros(size, np.float32), 0.0, 4.0, 1e-4
    last_w, last_b = w, b
    for r in range(ROUNDS):
        push = r / (r + 3)
        w_at, b_at = w + push * (w - last_w), b + push * (b - last_b)
        g = -t * share / (1 + np.exp(np.clip(t * (x @ w_at + b_at), -30, 30)))
        last_w, last_b = w, b
        w, b = w_at - rate * (x.T @ g + penalty * w_at), b_at - rate * float(g.sum())
    return w.astype(np.float64), float(b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Character model over all of ``docs``; weights from at most ``sample``
    labelled rows where ``learn`` (on the labels' id) holds.

    Features are chosen by chi-square over the sample, the best ``FEATURES`` of
    those that toxic rows hold surely more often. Without both labels scores are 0.
    The driver gets the trigram table and the chosen features of sampled rows.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    chars = char_model(char_counts(docs, text_col).toPandas())
    picked = labels.filter(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("_k"), "_k", "y").limit(sample)
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_k")).select("y", "_text"), "labelled")
    shared = spark.sparkContext.broadcast(chars)

    @worker("toxicity")
    def counted(batches: Iterator) -> Iterator:
        reader = Reader(shared.value)
        for b in batches:
            found = [reader.features(t.as_py()) for t in b.column(1)]
            y = np.repeat(b.column(0).to_numpy(), [len(f) for f in found])
            f, at = np.unique(np.array([i for x in found for i in x], dtype=np.int64), return_inverse=True)
            toxic = np.bincount(at, weights=y > 0, minlength=len(f)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(toxic), pa.array(np.bincount(at, minlength=len(f)).astype(np.int64))], names=["f", "a", "n"])

    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0))).first()
    if not toxic or toxic == n:
        return Model(chars, {}, np.zeros(0), -30.0)
    table = rows.mapInArrow(counted, "f long, a long, n long").groupBy("f").agg(F.sum("a").cast("double").alias("a"), F.sum("n").cast("double").alias("n"))
    p = toxic / n
    gain = (F.col("a") - F.col("n") * p) ** 2 / (F.col("n") * p * (1 - p) * (1 - (F.col("n") - 1) / n))
    best = table.filter((F.col("a") >= 2) & (F.col("a") > F.col("n") * p) & (F.col("n") < n) & (gain >= SURE)).orderBy(gain.desc(), "f").limit(FEATURES).select("f").collect()
    known = {r["f"]: k for k, r in enumerate(sorted(best, key=lambda r: r["f"]))}

    @worker("toxicity")
    def chosen(batches: Iterator) -> Iterator:
        reader = Reader(shared.value, known)
        for b in batches:
            found = [reader.features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "f"])

    data = rows.mapInArrow(chosen, "y int, f array<int>").toPandas()
    samples = sorted((int(y), [int(x) for x in f]) for y, f in zip(data["y"], data["f"]))
    weights, bias = logistic([f for _, f in samples], np.array([y for y, _ in samples]), len(known))
    return Model(chars, known, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, score (0 to 1, higher is likelier toxic), predicted.

    Empty and null texts get the score of a text without features. Whole texts;
    rows that repeat stay; an empty table gives no rows; other columns are
    ignored. No shuffle.
    """
    out = scored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return out.select(F.col("_id").alias(id_col), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """All columns of ``docs`` and _score, which replaces one of that name.

    Only the text goes to Python and only the score comes back; the other
    columns wait in the JVM.
    """
    import pyarrow as pa
    from pyspark.sql.functions import ArrowUDFType, arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @worker("toxicity")
    def run(columns: Iterator) -> Iterator:
        m = shared.value
        for texts in columns:
            yield pa.array([m.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn("_score", arrow_udf(run, "double", ArrowUDFType.SCALAR_ITER)(F.col(text_col)))

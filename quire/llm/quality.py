"""Quality rules as a short-circuit cascade.

Each rule rejects a document or lets it pass. On a bounded sample every rule is
timed and counted on the executors; rules then run in descending order of
rejections per second, and a document's first rejection ends its cascade. The
verdict does not depend on the order, only the time does. The counts of the base
rule are output for every document, so they are made once and shared by rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
#: ASCII that is no letter.
NO_LETTERS = bytes(x for x in range(128) if not (65 <= x <= 90 or 97 <= x <= 122))
#: Documents of the sample that orders the rules: the smallest id hashes.
SAMPLE = 400
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


class Text:
    """A document's words and the counts that rules share, each made once."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)

    @property
    def word_chars(self) -> int:
        if "_chars" not in self.__dict__:
            joined = b"".join(self.words)
            self._chars = len(joined.decode("utf-8", "surrogatepass"))
        return self._chars

    @property
    def n_symbols(self) -> int:
        if "_symbols" not in self.__dict__:
            self._symbols = len(self.raw) - len(self.raw.translate(None, SYMBOLS))
        return self._symbols

    @property
    def lines(self) -> list[bytes]:
        if "_lines" not in self.__dict__:
            self._lines = [x for x in self.raw.split(b"\n") if x.split(None, 1)]
        return self._lines

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that occur twice or more, first ones included."""
        if "_repeats" not in self.__dict__:
            self._repeats = repeat_words(self.words)
        return self._repeats


def repeat_words(words: list[bytes], k: int = 3) -> int:
    n = len(words)
    if n <= k:
        return 0
    code = dict(zip(dict.fromkeys(words), count()))
    ids = np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=n)
    if len(code) == n:
        return 0
    key, size = ids, len(code)
    for j in range(1, k):
        key = key[:-1] * len(code) + ids[j:]
        size *= len(code)
        if size >= 2**62 // max(len(code), 1) and j + 1 < k:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            size = len(key)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    for j in range(k):
        hit[j : j + len(key)] |= twice
    return int(hit.sum())


def counted(text: str | None) -> Text:
    """A text whose output counts, which every document needs, are made."""
    t = Text(text)
    _ = t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words
    return t


def few_words(t: Text) -> bool:
    return t.n_words < MIN_WORDS


def repeats(t: Text) -> bool:
    return 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words


def symbol_heavy(t: Text) -> bool:
    """Over one symbol for ten words."""
    return 10 * t.n_symbols > t.n_words


def odd_word_length(t: Text) -> bool:
    """Mean word length outside 2 to 20 code points."""
    return not 2 * t.n_words <= t.word_chars <= 20 * t.n_words


def duplicate_lines(t: Text) -> bool:
    """Over half of five or more lines repeat earlier ones."""
    return len(t.lines) >= 5 and 2 * t.n_dup_lines > len(t.lines)


def few_letters(t: Text) -> bool:
    """Letters are under half of all characters in words; characters beyond
    ASCII count as letters."""
    return 2 * len(t.raw.translate(None, NO_LETTERS).decode("utf-8", "surrogatepass")) < t.word_chars


#: The base rules decide base_failed; the others are the method's own.
BASE: dict[str, Callable[[Text], bool]] = {"few_words": few_words, "repeats": repeats}
RULES: dict[str, Callable[[Text], bool]] = {"symbol_heavy": symbol_heavy, "odd_word_length": odd_word_length, "duplicate_lines": duplicate_lines, "few_letters": few_letters}


def measure(docs: DataFrame, id_col: str, text_col: str, rules: dict[str, Callable[[Text], bool]], sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """{rule: (seconds a document, share rejected)} on the sample, measured where
    the rules run; the driver gets a row per rule. A rule's cost is what it adds:
    counts that are output for every document are made before the clock runs."""
    import pyarrow as pa

    @worker("none")
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            texts = b.column(0).to_pylist()
            for name, rule in rules.items():
                fresh = [counted(x) for x in texts]
                began = time.perf_counter()
                rejected = sum(map(rule, fresh))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([time.perf_counter() - began]), pa.array([rejected], pa.int64()), pa.array([len(texts)], pa.int64())], names=["rule", "s", "rejected", "n"])

    ids = docs.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = docs.select(F.col(id_col).alias("_k"), F.col(text_col).alias("_text")).join(F.broadcast(ids), F.col("_k").eqNullSafe(F.col("_id")), "left_semi").select("_text")
    rows = picked.mapInArrow(run, "rule string, s double, rejected long, n long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    return {r["rule"]: (r["s"] / r["n"], r["rejected"] / r["n"]) for r in rows}


def cascade_order(measured: dict[str, tuple[float, float]], rules: dict[str, Callable[[Text], bool]]) -> list[str]:
    """Most rejections per second first; ties, and rules without a measurement, by name."""
    worth = lambda name: measured.get(name, (1.0, 0.0))[1] / max(measured.get(name, (1.0, 0.0))[0], 1e-9)
    return sorted(rules, key=lambda name: (-worth(name), name))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, first_failed (the rule that ended the
    cascade, null if kept; its name depends on the measured order).

    A null or empty text has no words and fails the base rule. Rows that repeat
    stay; an empty table gives no rows; other columns are ignored; texts of any
    length are judged whole. No shuffle but that of the sample's ids.
    """
    import pyarrow as pa

    every = BASE | RULES
    order = cascade_order(measure(docs, id_col, text_col, every, sample), every)

    @worker("none")
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            columns: list[list] = [[] for _ in range(8)]
            for x in b.column(1):
                t = counted(x.as_py())
                failed = next((name for name in order if every[name](t)), None)
                base = few_words(t) or repeats(t)
                for column, value in zip(columns, (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, base, failed is None, failed)):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "first_failed"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, first_failed string")
    return out.withColumnRenamed("_id", id_col)

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, _id long, _row string, key string, size int, block int, token long, n int, _drops int"
LONG = " ".join(f"w{k * k % 9973} x{k % 13}" for k in range(9_900))
LINE = "This is a line that many documents hold"


def rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd white space."""
    texts = [
        (1, f"{LINE}\nfirst document has words of its own\r\nand more"), (2, f"  {LINE.upper()}\t\nsecond one\n\n"), (3, f"{LINE}\n{LINE}\nthird"), (4, LINE),
        (5, None), (6, ""), (7, "\n"), (8, " \t\x0b"), (9, LONG), (10, LONG + " end"), (11, "one two three four five"), (11, "one two three four five"),
        (12, "One TWO three four five"), (None, "no id here but some words to keep"), (None, None), (13, "a"), (14, "ÄÖÜ äöü ÄÖÜ"), (15, "漢字 かな 😀 emoji"), (16, "<|endoftext|> special <|endoftext|>"), (17, "12 34 !!"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, k, k, "r", "k", k, k, k, k, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    from quire.llm.common import ship

    ship(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

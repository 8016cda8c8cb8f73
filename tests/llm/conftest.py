import random

import pytest

WORDS = "the of and to in that for with alpha beta gamma delta omega stone river cloud paper light house green".split()
LONG = "word " * 30_000


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, edge cases: id -> text."""
    rng = random.Random(3)
    base = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(30)}" for _ in range(rng.randrange(20, 120))) for _ in range(30)]
    out = dict(enumerate(base))
    for i in range(40):
        w = base[i % 3].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"edit{i}x{rng.randrange(99)}"
        out[len(out)] = " ".join(w)
    chain = [f"c{k}" for k in range(100)]
    for step in range(8):  # each like the next, the ends unlike
        out[len(out)] = " ".join(chain[step * 2 :] + [f"d{k}" for k in range(step * 2)])
    for text in (None, "", "  \t\n ", "one", "One", "one two three", "ONE  two\tthree", LONG, LONG, "\x00bin", "é" * 50, "日本語 の 文 です ね", "a b c d e", "A b C d e"):
        out[len(out)] = text
    return out


@pytest.fixture(scope="session")
def table(spark):
    """Builds a documents table with clashing extra columns."""

    def make(docs, empty: bool = False):
        rows = [(d, t, "x", "s", None if t is None else len(t), d, "k", 1, 2) for d, t in docs.items()]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, h string, n int, part int"
        return spark.createDataFrame([] if empty else rows, schema)

    return make

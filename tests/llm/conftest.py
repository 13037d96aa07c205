import pytest

#: Columns that operators might use inside; they must survive or not matter.
CLASHES = ["run", "row", "sha", "kt_text", "kt_words", "kt_gone", "h1", "salt", "queue", "fp", "key", "n", "score", "kept", "id", "best", "part"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS)[:3] for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal and near texts, odd characters."""
    a = prose(1, 120)
    rows = [
        (1, a, "en", "s0", 5), (2, a, "en", "s0", 5), (3, a + " extra", "fr", "s1", 5), (4, None, None, None, None), (5, "", "en", "s0", 0), (6, " \t\n", "en", None, 3),
        (7, "x" * 200_000, "en", "s1", 5), (7, "x" * 200_000, "en", "s1", 5), (None, a, "en", "s0", 5), (None, "no id here", "de", "s0", 5), (8, "Ünï ÇÖDÉ　中文 😀 \x1c a b", "de", "s2", 5),
        (9, "same line of text\nother line here\nsame line of text", "en", "s0", 5), (10, "  SAME line of TEXT \nshort\n", "en", "s0", 5), (11, prose(2, 30_000), "en", "s0", 5),
        (12, "one two", "en", "s2", 5), (13, "don't it's <|endoftext|> </s>[INST]", "en", "s2", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in odd_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

import random

import pytest

#: Edge cases that every operator must bear, with columns whose names clash with those inside.
EXTRA = "key string, token long, n int, block string, row_key string, n_lines int, lost string, added string, width int, measures int, `a.b` int"


@pytest.fixture(scope="session")
def texts():
    rnd = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta,", "été", "naïve.", "x1", "don't", "日本", "zeta"] + ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 140))) for _ in range(12)]
    near = []
    for i in range(6):
        w = base[0].split(" ")
        w[10 + 7 * i] = f"edit{i}"
        near.append(" ".join(w))
    shared = "a line that several documents share\n"
    edge = [None, "", " ", "\n\n", "one", "two words", "  spaced   out  ", "tab\there \n mixed", "<|endoftext|> inside <|endoftext|>", "w" * 3000, "é" * 50 + "\x1c\x85 end "]
    # a very long text
    return base + near + [base[1], base[1]] + edge + [shared + base[2], "A Line that several documents share \n" + base[3], " ".join(base) * 5]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), "k", 1, 2, "b", "r", 3, "l", "a", 4, 5, 6) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], *[None] * 14)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

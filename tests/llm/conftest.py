import random

import pytest

LONG = " ".join(f"word{i % 977} is" for i in range(20_000))


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows: (doc_id, text, lang, source)."""
    base = "the quick brown fox jumps over the lazy dog and then walks slowly back to its den by the old river bank again"
    near = base.replace("slowly", "quickly")
    return [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (3, near, "en", None),
        (4, None, None, "a"),
        (5, "", "en", None),
        (6, " \t\n", None, "b"),
        (7, LONG, "en", "a"),
        (8, LONG + " tail", "en", "a"),
        (9, "two words", "en", "c"),
        (9, "two words", "en", "c"),
        (10, "Two WORDS", "en", "c"),
        (11, "éà ßü 日本 \U0001f600  x", "fr", "é"),
        (None, base, "en", "a"),
        (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    # clashing names of further columns
    rows = [(*r, "x", i) for i, r in enumerate(edge_rows())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string, n long").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def copies(spark):
    """Texts with exact and near copies and shared passages, by doc_id."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out, passage = [], text(30)
    for i in range(60):
        out.append(text(rng.randint(1, 120)))
        if i % 5 == 0:
            out.append(out[-1])
        if i % 4 == 0:
            changed = out[-1].split()
            for _ in range(1 + i // 20):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            out.append(" ".join(changed))
        if i % 7 == 0:
            out.append(text(20) + " " + passage + " " + text(15))
    hub = text(200).split()
    for i in range(40):  # a large group of near copies
        changed = list(hub)
        for _ in range(4):
            changed[rng.randrange(len(changed))] = f"edit{i}"
        out.append(" ".join(changed))
    return {i + 1: t for i, t in enumerate(out)}


@pytest.fixture(scope="session")
def copies_df(spark, copies):
    return spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(4).cache()

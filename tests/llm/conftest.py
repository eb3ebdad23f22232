import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "re", "sö") for b in ("ta", "vi", "xe", "zu") for c in ("n", "r", "s", "", "é")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor long, _key string, starts string, n int"


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", " ", ". ", ", ", "\n"]) for _ in range(n)).strip()


def edge_rows(seed=7):
    """Documents with every awkward case: see the inline notes."""
    rng = random.Random(seed)
    base, passage = prose(rng, 260), prose(rng, 90)
    texts = [
        (1, base, "a"),
        (2, base, "a"),  # an exact copy
        (3, base.replace(base.split()[40], "changed", 1), "a"),  # near copies
        (4, " ".join(base.split()[:250]) + " and an ending", "b"),
        (5, prose(rng, 120) + "\n" + passage + "\n" + prose(rng, 60), "b"),  # a shared passage
        (6, passage, "b"),
        (7, prose(rng, 30) + " " + passage, None),
        (8, None, "a"),
        (9, "", "b"),
        (10, " \n\t ", "c"),
        (11, "one two three", "c"),  # shorter than a shingle
        (12, "ONE two three", "c"),
        (13, "x" * 900, "d"),  # one word, one byte over and over
        (14, "word " * 400, "d"),
        (15, prose(rng, 30) + "\n" + "same line here\n" * 12, "d"),
        (16, "é𝔘 中 " * 120, "e"),
        (17, prose(rng, 4000), "e"),  # very long
        (18, "###$$$ %%% &&& <b> | *", "e"),
        (None, base, "a"),  # no id
        (None, None, None),
        (20, prose(rng, 45) + " " + passage.upper(), "e"),
        (21, "tab\tand  spaces , . \r\n  end ", "e"),
    ]
    texts += [texts[5], texts[16], (22, prose(rng, 80), "a"), (22, prose(rng, 70), "a")]  # repeated rows; one id, two texts
    texts += [(100 + i, " ".join(w if rng.random() > 0.01 else "edit" + str(i) for w in base.split()), "f") for i in range(25)]  # a group of near copies
    texts += [(200 + i, prose(rng, 60), rng.choice("abf")) for i in range(20)]
    return [(d, t, "xx", s, len(t) if t is not None else None, 7, "clash", "clash", 1) for d, t, s in texts]


@pytest.fixture(scope="session")
def edges(spark):
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, edges):
    return spark.createDataFrame(edges, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs(edges):
    return [(r[0], r[1]) for r in edges]

import random

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases by id: nulls, empties, long texts, copies, near copies, other scripts."""
    base = sentence(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["CHANGED"] + words[61:])
    rows = [
        (0, base), (1, base), (2, near), (3, sentence(2, 90)), (4, None), (5, ""), (6, "   \n\t"), (7, "one two"), (8, "one two"), (9, sentence(3, 9000)),
        (10, "日本語 ñandú über çà 😀\n" * 3), (11, "a" * 3000), (12, sentence(4, 50) + "\n" + "shared line of more than twenty characters"),
        (13, "Shared Line of more than twenty characters \n" + sentence(5, 40)), (14, "x\nshared line of more than twenty characters"), (15, "password=f15e0414f5681d94af and token = \"1dbdfc8c8e65b434924454049ac802522025d556\" mail bob.x1@example.com, 10.2.3.4"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The edge cases with a null id, a repeated row and columns whose names clash."""
    rows = [(i, t, "en", f"src{i % 3}" if i and i % 4 else None, 7, "k", "v", 1) for i, t in [*texts, (3, texts[3][1]), (None, "nobody owns this text at all")]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, value string, c int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)

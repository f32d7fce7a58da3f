import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: exact and near copies, shared passages, repetition, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(11)
    base = [words(rng, rng.randrange(5, 300)) for _ in range(40)]
    passage = words(rng, 120, 5000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(15)] + [(120, base[1].upper()), (121, base[1])]
    for i in range(60):  # near copies of one text
        w = base[2].split()
        w[rng.randrange(len(w))] = f"x{rng.randrange(3)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, words(rng, 30) + " " + passage + " " + words(rng, 20)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, None), (403, " \t\n"), (404, "Der " * 3000), (405, "ß" * 700 + " é  x  y\r\nz "), (406, words(rng, 60_000)), (407, "one two"), (408, "!!!")]
    rows += [(500, base[3]), (500, base[3]), (None, base[4]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 1) for i, t in texts], COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark, texts):
    """The same with more columns, whose names the operators use inside."""
    names = "score label at fp key sha size shard cell slot print doc spans row w n words h held_out norm".split()
    return spark.createDataFrame([(i, t, *range(len(names))) for i, t in texts], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def items(spark, texts):
    passage = dict((i, t) for i, t in texts if i == 300)[300]
    rows = [(1, passage), (2, "w1 w2"), (3, None), (4, ""), (5, "ONE, two!"), (None, passage), (6, passage), (7, " ".join(passage.split()[40:50]))]
    return spark.createDataFrame(rows, "item_id long, text string")

import random

import pytest

#: Words that are long, short, accented, and white space of all kinds between them.
WORDS = ["a", "the", "of", "Kari", "kari", "straße", "naïve", "日本", "x" * 40, "42", "e-mail,", "(x)", "%%%", "Ünïcode"]


@pytest.fixture
def texts():
    """Texts with repeats, copies, near copies and edge cases, in a fixed order."""
    r = random.Random(7)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(5, 120))) for _ in range(40)]
    near = [t.replace(" ", "\n", 1) + " tail" for t in base[:10]] + [" ".join(t.split(" ")[: len(t.split(" ")) - 2]) for t in base[10:20]]
    shared = "passage " + " ".join(f"p{k}" for k in range(60))
    with_passage = [f"{t}\n{shared} {k}" for k, t in enumerate(base[20:30])]
    edge = [None, "", "   ", "\n\t", "one", "One", "two words", " two\t words ", "a\u00a0b", "x " * 300, ("long " * 5 + "\n") * 200]
    out = base + near + with_passage + edge + base[:5] + [base[0]] * 12
    r.shuffle(out)
    return out


@pytest.fixture
def docs(spark, texts):
    """Documents with extra columns whose names clash with those that operators use inside."""
    rows = [(i, t, f"h{i % 3}" if i % 7 else None, "x", i, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, h string, id long, n int").repartition(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")

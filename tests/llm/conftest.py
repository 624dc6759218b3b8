import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "the of and river stone light water under over house tree green small large old new long short day night".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(id, text) rows: nulls, empty and blank texts, copies, near copies, chains of edits, shared passages, long texts."""
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  two"), (5, "é" * 300)]
    base = [passage(rng, 60) for _ in range(6)]
    common = passage(rng, 40)
    for k, text in enumerate(base):
        words = text.split()
        rows.append((10 + 10 * k, text))
        rows.append((11 + 10 * k, text.upper()))
        rows.append((12 + 10 * k, text + "  "))
        for step in range(5):  # each differs from the one before in few words
            words[(7 * step) % len(words)] = f"edit{k}{step}"
            rows.append((13 + 10 * k + step, " ".join(words)))
    rows += [(100 + k, passage(rng, 20) + " " + common + " " + passage(rng, 20)) for k in range(6)]
    rows.append((200, passage(rng, 3000) + " " + common + " " + common))
    rows.append((201, "x" * 400))
    rows.append((202, common[:99]))
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    schema = "doc_id long, text string, score string, component_id string, id long, kept int"
    return spark.createDataFrame([(i, t, "clash", None, i % 3, 7) for i, t in corpus], schema)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.filter("false")

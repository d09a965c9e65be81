import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, node string, component double, name string, h string, n string, row string, score string, found string, shard string, media string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, copies, repeated rows, rows without doc_id, a very long text."""
    passage, other = words(1, 80), words(2, 80)
    return [(1, None), (2, ""), (3, passage), (4, passage), (5, other), (5, other), (None, passage), (None, None), (6, words(3, 60_000)), (7, " \t\n "), (8, "é"), (9, "😀 中文 ß"), (10, "x")]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """The same with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, *[None] * 14) for r in edge_rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}

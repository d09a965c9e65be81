import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import common, ngram_join, queries
from tests.llm.conftest import union_find, words


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = {d: shingle_set(t, k) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = union_find(ids, links)
    return {d: (len(sets[d]), found[d]) for d in ids}


def near_copies(seed=0):
    rng, rows = random.Random(seed), []
    for base in range(12):
        text = words(base, rng.choice([1, 2, 3, 15, 16, 30, 200, 500])).split()
        for _ in range(6):
            copy = list(text)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.03, 0.1]))):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "words", "HERE"])
            rows.append((len(rows) * 7 % 1000, rng.choice([" ", "\n", "\t  "]).join(copy)))
    return rows


def test_join_equals_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df, k, percent).collect()} == brute(rows, k, percent)


def test_large_component_is_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    rng, text, rows = random.Random(3), words(9, 120).split(), []
    for i in range(60):
        copy = list(text)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(120)] = f"w{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df, 3, 90).collect()} == brute(rows, 3, 90)


def test_linked_sets_share_a_key():
    """The lemma behind the prefixes, over rare, frequent and very frequent tokens."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        percent, n = int(rng.choice([80, 90])), int(rng.integers(1, 260))
        x = rng.integers(1, 1 << 62, n).astype(np.uint64)
        drop = int(rng.integers(0, max(1, n // 8) + 1))
        y = np.unique(np.r_[x[drop:], rng.integers(1, 1 << 62, int(rng.integers(0, max(1, n // 8) + 1))).astype(np.uint64)])
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < percent * (len(x) + len(y) - both):
            continue
        kind = int(rng.integers(0, 3))
        often = lambda t: (t % np.uint64(7) * np.uint64((1, 30, 1500)[kind])).astype(np.int64)

        def keys(tokens):
            order = np.lexsort((tokens, often(tokens)))
            tokens = tokens[order]
            size, band = len(tokens), len(tokens).bit_length() - 1
            least = -(-percent * size // 100)
            bands = (band, band - 1) if least < 1 << band else (band,)
            return {(b, int(k)) for b in bands for part in ngram_join._keys(tokens, often(tokens), size - least, 1 << b) for k in part}

        assert keys(x) & keys(y), (percent, len(x), len(y), kind)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(200):
        x = rng.integers(1, 1 << 62, int(rng.integers(1, 400))).astype(np.uint64)
        y = np.unique(np.r_[x[int(rng.integers(0, 5)) :], rng.integers(1, 1 << 62, 4).astype(np.uint64)])
        x = np.unique(x)
        a, b = ngram_join._parity(x), ngram_join._parity(y)
        while len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(x, y))


def test_defined_cases(edges, edge_rows, empty):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(edges, 3, 90).collect()]
    assert len(found) == len(edge_rows)
    assert (1, 0, 1) in found and (2, 0, 2) in found and (7, 0, 7) in found and (8, 1, 8) in found
    assert (3, 78, 3) in found and (4, 78, 3) in found and (None, 78, 3) in found and (None, 0, None) in found
    assert found.count((5, 78, 5)) == 2 and (6, len(shingle_set(words(3, 60_000), 3)), 6) in found
    assert ngram_join.ngram_jaccard_join(empty, 3, 90).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, same, name):
    assert same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.SQL[name]) > 1


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    want = union_find({x for e in links for x in e}, links)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n and list(want.values()).count(n) == 1 for n in set(want) - set(got))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_grows_with_the_input(spark, monkeypatch):
    assert ngram_join.sketch_bits(500_000_000) == 20 and ngram_join.sketch_bits(6_000_000_000) == 24 and ngram_join.sketch_bits(1 << 50) == ngram_join.SKETCH_BITS_MOST
    rows = near_copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "sketch_bits", lambda size: 22)
    counts = ngram_join._sketch(df, 3)
    assert len(counts) == 1 << 22 and int(counts.sum()) == sum(max(1, len(t.split()) - 2) for _, t in rows if t.split())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df, 3, 90).collect()} == brute(rows, 3, 90)


def test_bitmaps_are_as_long_as_the_allowed_difference():
    x = np.random.default_rng(1).integers(1, 1 << 62, 400).astype(np.uint64)
    assert len(ngram_join._parity(x, 90)) == 2 and len(ngram_join._parity(x, 80)) == 8 and len(ngram_join._parity(x)) == 16


def test_staging_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files, names = disk.getAllFiles().iterator(), set()
        while files.hasNext():
            names.add(files.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffles()
    common.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before


def test_join_deletes_what_it_no_longer_reads(spark):
    root = common.shared_dir(spark).removeprefix("file://")
    staged = lambda: {(d, n) for d in os.listdir(root) if d.startswith("stage-") for n in os.listdir(f"{root}/{d}")}
    before = staged()
    ngram_join.ngram_jaccard_join(spark.createDataFrame(near_copies(), "doc_id long, text string"), 3, 90)
    assert not {"scan", "classes", "reps", "moved"} & {n for _, n in staged() - before}

import hashlib
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from leafspan.llm import common
from leafspan.llm import paragraph_dedup as pd6
from leafspan.llm import suffix_dedup as sd
from leafspan.llm import textscan as ts
from tests.llm.conftest import union_find, words


def remove(rows, length=100):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        body = (t or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            w = body[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen[w] = (d, i)
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[d] = (len(body), sum(gone), sum(1 for i in range(len(body)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def digest(df):
    return df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("gone"), F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha"))


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    parts = [words(i, 40) for i in range(6)] + ["ab" * 90, "-" * 350, "é" * 120, "passage " * 30]
    rows = [(i * 3 % 101, " ".join(rng.choice(parts)[rng.randrange(40) :] for _ in range(rng.randint(0, 5))) + words(1000 + i, rng.randint(0, 30))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r[1:]) for r in digest(sd.remove_repeats(df)).collect()} == remove(rows)


def test_suffix_dedup_of_the_table(spark):
    rows = duckdb.execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert {r[0]: tuple(r[1:]) for r in sd.op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()} == remove(rows)


def test_suffix_dedup_of_a_text_longer_than_a_scan(spark):
    part = words(5, 90_000)
    rows = [(1, part * 5), (2, part[1000:200_000])]
    found = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found[1].kept) < len(part) + 200 and len(found[2].kept) == 0


def test_suffix_dedup_defined_cases(edges, edge_rows, empty):
    found = [(r.doc_id, r.n_bytes, len(r.kept)) for r in sd.remove_repeats(edges).collect()]
    size = len(words(1, 80))
    assert len(found) == len(edge_rows) and (1, 0, 0) in found and (None, 0, 0) in found
    assert (None, size, size) in found and (3, size, 0) in found and (4, size, 0) in found  # the row without id comes first
    assert found.count((5, len(words(2, 80)), len(words(2, 80)))) == 2
    assert sd.remove_repeats(empty).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    again, other, alone = words(71, 40)[:150], words(72, 100)[:400], words(73, 200)
    rows = [(7, again + alone[:300] + again), (7, other), (None, again + "x" * 60), (None, other[:90]), (None, alone[500:900]), (None, None), (None, None)]
    found = [(r.doc_id, r.n_bytes, len(r.kept)) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(7, 600, 300), (7, 400, 400), (None, 210, 210), (None, 90, 90), (None, 400, 400), (None, 0, 0), (None, 0, 0)], key=str)


def test_one_string_in_very_many_texts(spark):
    hot, rng = words(74, 20)[:45], random.Random(5)
    rows = [(i, words(2000 + i, 12)[:60] + hot + words(9000 + i, 12)[:60]) for i in range(3000)]
    rows += [(5000 + i, rng.choice(rows)[1][20:150]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r[0]: tuple(r[1:]) for r in digest(sd.remove_repeats(df)).collect()} == remove(rows)


def test_bucket_pointers_order_suffixes():
    rng = random.Random(6)
    for alphabet, n in (("ab", 3000), ("a", 1000), ("abcdefgh", 2000)):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 400))).encode() for _ in range(n // 200)]
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        pointer = sd.suffix_order(data, ends, 100)
        suffixes = [bytes(data[i:e]) for i, e in enumerate(ends)]
        whole = [i for i, x in enumerate(suffixes) if len(x) >= 100]
        by = sorted(whole, key=lambda i: pointer[i])
        for i, j in zip(by, by[1:]):
            assert suffixes[i][:100] <= suffixes[j][:100] and (pointer[i] < pointer[j] or suffixes[i][:100] == suffixes[j][:100])


WORD = re.compile(r"[^\x20\x09-\x0d]+")


def paragraphs(text):
    """Spans, words and places of the paragraphs of a text, cut word by word."""
    text, out = text or "", []
    lines = [[(x.start() + m.start(), x.end() + m.start()) for x in WORD.finditer(m.group())] for m in re.finditer(r"[^\n]+", text)]
    wholes, last = [], None
    for line in filter(None, lines):
        long = len(line) >= pd6.WRAP
        if wholes and not long and not last:
            wholes[-1] += line
        else:
            wholes.append(list(line))
        last = long
    parts, parted = [], []
    for spans in wholes:
        joined = " ".join(text[s:e] for s, e in spans)
        data = np.frombuffer(joined.encode(), np.uint8)
        hashes, _ = ts.word_hashes(data, np.array([0, len(data)]))
        n = len(spans)
        pair = [None, *(int(ts.mix(hashes[i - 1 : i] * pd6._STEP + hashes[i : i + 1])[0]) for i in range(1, n))]
        cuts = [i for i in range(pd6.PARAGRAPH, n - pd6.PARAGRAPH + 1) if all(pair[i] < pair[j] for j in range(i - pd6.CUT, i)) and all(pair[i] <= pair[j] for j in range(i + 1, i + pd6.CUT + 1))]
        parts += [(spans[s][0], spans[e - 1][1], e - s) for s, e in zip([0, *cuts], [*cuts, n]) if e - s >= pd6.PARAGRAPH]
        parted += [(spans[0][0], spans[-1][1], n)] if cuts else []
    return [*((*p, k) for k, p in enumerate(parts)), *((*p, pd6.WHOLE + k) for k, p in enumerate(parted))]


def clusters(rows):
    lower, of, every = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s), defaultdict(list), []
    for d, t in rows:
        for s, e, n, k in paragraphs(t):
            w = tuple(WORD.findall(lower(t[s:e])))
            of[w].append((d, k))
            every.append((d, k, s, e, n, w))
    sets = {w: {w[i : i + 5] for i in range(len(w) - 4)} for w in of}
    holders, shared = defaultdict(list), defaultdict(int)
    for w, s in sets.items():
        for g in s:
            holders[g].append(w)
    for l in holders.values():
        for i, a in enumerate(l):
            for b in l[:i]:
                shared[a, b] += 1
    root = union_find(of, [(a, b) for (a, b), c in shared.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)])
    group = defaultdict(list)
    for w in of:
        group[root[w]] += of[w]
    docs, out = defaultdict(list), {}
    for d, k, s, e, n, w in every:
        if len(group[root[w]]) > 1:
            docs[d].append((k, s, e, n, min(group[root[w]])))
    for d, found in docs.items():
        found.sort()
        i = 0
        while i < len(found):
            j = i
            while j + 1 < len(found) and found[j + 1][0] == found[j][0] + 1 and found[j + 1][4][0] == found[j][4][0] and (found[j + 1][4] != (d, found[j + 1][0])) == (found[j][4] != (d, found[j][0])):
                j += 1
            if sum(x[3] for x in found[i : j + 1]) >= pd6.RUN:
                out |= {(d, k): (s, e, n, *first, first != (d, k)) for k, s, e, n, first in found[i : j + 1]}
            i = j + 1
    return out


def test_paragraph_dedup_equals_brute_force(spark):
    rows = duckdb.execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = {(r.doc_id, r.place): (r.start, r.end, r.words, r.keep_doc_id, r.keep_place, r.removed) for r in pd6.op6_paragraph_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == clusters(rows) and len(got) > 20


def test_paragraph_dedup_finds_an_edited_passage(spark):
    passage = words(77, 60).split()
    edited = list(passage)
    edited[30] = "CHANGED"
    rows = [(1, words(1, 50) + "\n" + " ".join(passage) + "\n" + words(2, 20)), (2, words(3, 40) + "\n" + " ".join(edited)), (3, words(4, 90)), (4, "short line " * 4)]
    found = {(r.doc_id, r.removed) for r in pd6.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, False), (2, True)}


def test_paragraph_dedup_finds_a_passage_amid_a_line(spark):
    passages, rows = [words(300 + i, 60) for i in range(20)], []
    for i in range(40):
        around = words(500 + i, 90).split(" ")
        at = (i * 7) % 90
        rows.append((i, " ".join([*around[:at], passages[i % 20], *around[at:]])))
    rows += [(100 + i, words(700 + i, 150)) for i in range(20)]
    found = {r.doc_id: r.removed for r in pd6.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found.get(i, False) for i in range(20, 40)) >= 19 and not any(i >= 100 for i in found)


def touched(spark, rows):
    """Words removed by document."""
    found = pd6.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()
    texts, gone = dict(rows), {}
    for r in found:
        gone.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return {d: sum(1 for m in WORD.finditer(texts[d]) if m.start() in g) for d, g in gone.items()}


def test_paragraph_dedup_finds_wrapped_passages_and_short_lines(spark):
    wrap = lambda text, n: "\n".join(" ".join(text.split(" ")[i : i + n]) for i in range(0, len(text.split(" ")), n))
    verse, prose = words(81, 72), words(82, 120)
    rows = [(1, words(1, 60) + "\n" + wrap(verse, 6) + "\n" + words(2, 50)), (2, wrap(verse, 6)), (3, wrap(prose, 11)), (4, wrap(words(3, 30), 9) + "\n" + wrap(prose, 14) + "\n" + wrap(words(4, 30), 10))]
    found = touched(spark, rows)
    assert set(found) == {2, 4} and found[2] == 72 and found[4] >= 90


def test_whole_paragraphs_link_at_four_fifths(spark):
    """Paragraphs with words changed here and there: those of a similarity of 0.8 or more go whole."""
    rng, rows, want = random.Random(9), [], set()
    for i in range(60):
        text = words(3000 + i, 120).split(" ")
        other = list(text)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            other[at] = "changed%d" % at
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        a, b = ({tuple(t[j : j + 5]) for j in range(116)} for t in (text, other))
        if 100 * len(a & b) >= 80 * len(a | b):
            want.add(2 * i + 1)
    found = touched(spark, rows)
    whole = {d for d, n in found.items() if n == 120}
    print("whole paragraphs found", len(want & whole) / len(want))
    assert len(want & whole) >= 0.97 * len(want) and len(want) > 25 and whole <= want


def test_many_rows_without_an_id(spark):
    rows = [(None, words(4000 + i, 40)) for i in range(300)] + [(None, words(5000 + i % 10, 60) + " " + str(i)) for i in range(60)]
    found = pd6.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(not r.removed and r.place >= pd6.WHOLE for r in found) == 10 and sum(r.removed and r.place >= pd6.WHOLE for r in found) == 50


def test_paragraph_dedup_defined_cases(edges, empty):
    found = {(r.doc_id, r.keep_doc_id, r.removed) for r in pd6.repeated_paragraphs(edges).collect()}
    assert found == {(None, None, False), (3, None, True), (4, None, True)}
    assert pd6.repeated_paragraphs(empty).count() == 0


def test_paragraph_dedup_deletes_what_it_no_longer_reads(spark):
    root = common.shared_dir(spark).removeprefix("file://")
    staged = lambda: {(d, n) for d in os.listdir(root) if d.startswith("stage-") for n in os.listdir(f"{root}/{d}")}
    before, passage = staged(), words(5, 60)
    rows = [(1, passage + "\n" + words(6, 60)), (2, words(7, 60) + "\n" + passage), (3, words(8, 60))]
    found = pd6.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not {"places", "classes", "nodes", "links", "clusters", "keep", "repeated"} & {n for _, n in staged() - before}
    assert {(r.doc_id, r.removed) for r in found.collect()} == {(1, False), (2, True)}

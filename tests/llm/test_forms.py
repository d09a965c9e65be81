import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from leafspan.llm import chat_tree, media, packing
from leafspan.llm.tokens import decoder
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


# --- packing ---

def whole(rows, texts):
    """Assert that the pieces hold each text's ids once, in gapless windows; returns the windows' lengths."""
    exact, got, windows = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 0 < r.length <= packing.WINDOW and len(r.ids) == 4 * r.length
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(got[doc], key=lambda r: r.start)
        assert [p.start for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces)])[:-1]) and all(p.doc_tokens == len(ids) for p in pieces)
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == ids
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return [sum(n for _, n in held) for held in windows.values()]


def test_packing_of_the_table(spark):
    texts = dict(duckdb.execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    sizes = whole(packing.pack(spark.read.parquet(f"{DATA}/documents.parquet"), PATH).collect(), texts)
    assert sum(s < packing.WINDOW for s in sizes) <= 1
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packing.op7_retrieval_packing(spark, DATA).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(r.ids) for r in packing.pack(spark.read.parquet(f"{DATA}/documents.parquet"), PATH).collect())


def test_neighbours_share_words():
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 * t, 100 * t + 90, 300) for t in range(8)]
    rests = [rng.permutation(topics[i % 8])[:256].astype(np.uint32) for i in range(32)]
    windows = packing.pack_shard(rests)
    assert len(windows) == 8 and all(len({doc % 8 for doc, _, _ in w}) == 1 for w in windows)


def bm25(rests, query):
    """Scores of all leftovers for one of them, by the formula."""
    from collections import Counter

    held, mean = Counter(t for r in rests for t in set(r.tolist())), sum(map(len, rests)) / len(rests)
    out = []
    for r in rests:
        times = Counter(r.tolist())
        out.append(sum(np.log1p((len(rests) - held[t] + 0.5) / (held[t] + 0.5)) * times[t] * 2.2 / (times[t] + 1.2 * (0.25 + 0.75 * len(r) / mean)) for t in set(rests[query].tolist()) if t in times))
    return np.array(out)


def test_scores_equal_the_formula():
    rng = np.random.default_rng(8)
    rests = [(rng.zipf(1.4, int(rng.integers(1, 120))) % 500).astype(np.uint32) for _ in range(60)]
    first, count, docs, weights, terms, of, dense = packing._index(rests, packing.Statistics.of(rests, 500))
    for seed in range(60):
        score = dense[seed].astype(float)
        for t in terms[of[seed] : of[seed + 1]]:
            np.add.at(score, docs[first[t] : first[t] + count[t]], weights[first[t] : first[t] + count[t]])
        want = bm25(rests, seed)
        others = np.arange(60) != seed  # tokens of one leftover alone are not indexed
        assert np.allclose(score[others], want[others], rtol=1e-4, atol=1e-4)


def test_neighbours_share_a_shard(spark, monkeypatch):
    """The ten nearest of an index over all documents, and how many of them lie in the seed's own shard."""
    monkeypatch.setattr(packing, "SHARD", 128)
    rng = np.random.default_rng(9)
    common, topics = rng.integers(0, 200, 4000), [rng.integers(200 + 150 * t, 200 + 150 * t + 150, 200) for t in range(60)]
    rests = [np.r_[rng.choice(common, 60), rng.choice(topics[i % 60], 80)].astype(np.uint32) for i in range(1800)]
    held = spark.createDataFrame([(i, len(r), bytearray(r.astype("<u4").tobytes())) for i, r in enumerate(rests)], "doc_id long, n long, ids binary")
    statistics = packing.Statistics.of(rests, 10_000)
    shard = {r.doc_id: r.shard for r in packing.deal(held, statistics).collect()}
    sizes = np.unique(list(shard.values()), return_counts=True)[1]
    assert len(sizes) > 8 and sizes.max() <= 200
    near = together = 0
    for seed in range(0, 1800, 90):
        score = bm25(rests, seed)
        score[seed] = -1
        for other in np.argsort(-score, kind="stable")[:10]:
            near, together = near + 1, together + (shard[int(other)] == shard[seed])
    print("recall at 10", together / near)
    assert together >= 0.9 * near


def test_very_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 256)
    rows = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same few words' AS text").union(spark.range(500).selectExpr("id", "concat('own ', id, ' words ', id * 7) AS text"))
    pieces = packing.pack(rows, PATH).collect()
    assert len([p for p in pieces if p.start == 0]) == 20_500
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id >> 26, set()).add((p.doc_id, p.sequence_id))
    assert len(windows) > 60 and sum(p.length for p in pieces if p.doc_id is None) == 20_000 * pieces[0].doc_tokens if pieces[0].doc_id is None else True


def test_shard_holds_every_id_once():
    rng = np.random.default_rng(3)
    rests = [rng.integers(0, 500, int(rng.integers(0, 1024))).astype(np.uint32) for _ in range(200)]
    windows = packing.pack_shard(rests)
    seen = sorted((d, i) for w in windows for d, s, e in w for i in range(s, e))
    assert seen == sorted((d, i) for d, r in enumerate(rests) for i in range(len(r)))
    assert all(sum(e - s for _, s, e in w) == 1024 for w in windows[:-1])


def test_encoder_equals_the_tokenizer():
    encode, exact = packing.encoder(PATH), Tokenizer.from_file(PATH)
    for text in ["", "a", " \n\n\t x", "don't 12 é 中文 😀", "<|endoftext|> x", words(3, 500), "x" * 5000, "  é\r\n", "\x00\x01"]:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_packing_defined_cases(edges, edge_rows, empty):
    rows = packing.pack(edges, PATH).collect()
    assert len([r for r in rows if r.start == 0]) == len(edge_rows) and len([r for r in rows if r.doc_id == 5 and r.start == 0]) == 2
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id in (1, 2)] == [(1, 1)] * 2
    assert packing.pack(empty, PATH).count() == 0


# --- media ---

@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 200_000])
def test_png_round_trip(n):
    body = media.pad(random.Random(n).randbytes(n))
    stored = media.encode(body)
    assert media.decode(stored).tobytes() == body and len(media.cosine_hash(media.decode(stored))) == 8


def test_all_filters():
    rng = np.random.default_rng(1)
    rows, out, kinds = rng.integers(0, 256, (40, 64)).astype(int), [], [int(k) for k in rng.integers(0, 5, 40)]
    for y, kind in enumerate(kinds):
        up = rows[y - 1] if y else np.zeros(64, int)
        line = []
        for x in range(64):
            a, b, c = (rows[y][x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c)[kind]
            line.append((rows[y][x] - guess) & 255)
        out.append(line)
    assert (media._unfilter(np.array(kinds), np.array(out, np.uint8)) == rows).all()


def filtered(raw, bpp, kinds):
    """Rows as an encoder writes them, byte by byte."""
    out, before = [], bytes(len(raw[0]))
    for row, kind in zip(raw, kinds):
        line = [kind]
        for x, value in enumerate(row):
            a, b, c = (row[x - bpp] if x >= bpp else 0), before[x], (before[x - bpp] if x >= bpp else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((value - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        out.append(bytes(line))
        before = row
    return b"".join(out)


@pytest.mark.parametrize("colour,depth", [(c, d) for c, (_, depths) in media.COLOURS.items() for d in depths])
def test_all_forms_of_the_format(colour, depth, monkeypatch):
    import struct

    monkeypatch.setattr(media, "BAND", 7)
    rng, (channels, _) = np.random.default_rng(colour * 20 + depth), media.COLOURS[colour]
    width, height = 13, 24
    samples = rng.integers(0, min(1 << depth, 200) if colour == 3 else 1 << depth, (height, width * channels))
    bits = ((samples[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8).reshape(height, -1)
    raw = [r.tobytes() for r in np.packbits(bits, axis=1)]
    lines = filtered(raw, max(1, channels * depth // 8), [*rng.integers(0, 3, 7).tolist(), *rng.integers(0, 5, 17).tolist()])
    palette = rng.integers(0, 256, (1 << depth if depth < 8 else 200, 3)).astype(np.uint8)
    stored = b"".join([media.SIGNATURE, media._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)), *([media._chunk(b"PLTE", palette.tobytes())] if colour == 3 else []), media._chunk(b"IDAT", zlib.compress(lines)), media._chunk(b"IEND", b"")])
    found = media.decode(stored)
    want = palette[samples] if colour == 3 else samples if channels == 1 else samples.reshape(height, width, channels)
    assert (found == want).all() and media.brightness(found).shape == (height, width) and len(media.cosine_hash(media.brightness(found))) == 8


def test_cosine_hash_by_the_plain_transform():
    rng = np.random.default_rng(4)
    for shape in ((64, 64), (96, 32), (320, 64)):
        samples = rng.integers(0, 256, shape).astype(np.uint8)
        mean = samples.reshape(32, shape[0] // 32, 32, shape[1] // 32).mean(axis=(1, 3))
        low = np.array([[sum(mean[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
        bits, margin = np.unpackbits(np.frombuffer(media.cosine_hash(samples), np.uint8)), np.abs(low - np.sort(low[1:])[31])
        assert ((low > np.sort(low[1:])[31]) == bits)[margin > 1].all() and (margin > 1).sum() > 50


def test_broken_media_read_as_invalid(spark):
    good = media.encode(media.pad(b"hello"))
    bad = [None, b"", good[:-1], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"GIF" + good, good[:8] + good[8 + 25 :], media.SIGNATURE]
    found = {r.k: r for r in media.read_png(spark.createDataFrame(list(enumerate([good, *bad])), "k int, media binary"), keys=("k",)).collect()}
    assert found[0].valid and found[0].payload_sha256 == hashlib.sha256(media.pad(b"hello")).hexdigest()
    assert not any(found[k].valid or found[k].phash for k in range(1, 8))


def test_media_query(spark):
    texts = dict(duckdb.execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    for r in media.op9_media_columns(spark, DATA).collect():
        body = texts[r.doc_id].encode()
        padded = media.pad(body)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.encode(padded)).hexdigest() and r.media_bytes == len(media.encode(padded))


def test_similar_payloads_have_similar_hashes():
    body = bytearray(words(1, 3000).encode())
    one = media.cosine_hash(media.decode(media.encode(media.pad(bytes(body)))))
    body[5000:5010] = b"##########"
    two = media.cosine_hash(media.decode(media.encode(media.pad(bytes(body)))))
    assert bin(int.from_bytes(one) ^ int.from_bytes(two)).count("1") <= 12


def test_media_defined_cases(edges, edge_rows, empty):
    found = media.read_png(media.store_png(edges), keys=("doc_id", "n_bytes")).collect()
    assert len(found) == len(edge_rows) and all(r.valid for r in found)
    assert {r.height * r.width for r in found if r.doc_id in (1, 2)} == {64}
    assert media.store_png(empty).count() == 0


# --- chat ---

def test_escapes_come_back():
    rng = random.Random(1)
    parts = ["\\", "[", "INST]", "[INST]", "[/INST]", "</s>", " ", "<", "s>", "/", "]", "[ROLE:", "ok", "<<SYS>>", "<</SYS>>", "\n", "%5D"]
    for _ in range(20_000):
        turns = [(rng.choice(["user", "assistant", "system", "to]ol", "x\\", "", "[INST]"]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 3))]
        assert chat_tree.parse("".join("".join(chat_tree.format_turn(*t)) for t in turns)) == turns


CHAT = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "why"), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (5, 0, "tool", None), (5, 1, None, "x"), (6, 0, "user", "a"), (6, 0, "user", "a"), (None, 2, "assistant", ""), (None, None, "user", "q"), (7, 0, "user", "<|endoftext|> \\ [INST]")]
KIND = "conv_id long, turn long, role string, text string, leaf string, tree int, paths string"


def grown(spark, rows):
    trees, places = chat_tree.chat_trees(spark.createDataFrame([(*r, None, None, None) for r in rows], KIND), PATH)
    return trees.cache(), places.cache()


def decoded(node, tree):
    return decoder(PATH)(tree.tokens[node.start : node.end]).decode()


def test_shared_turns_stand_once(spark):
    trees, places = grown(spark, CHAT)
    shared = next(t for t in trees.collect() if any("hi" in decoded(n, t) for n in t.nodes))
    assert [decoded(n, shared) for n in shared.nodes][0] == "[INST] hi [/INST]" and sum("yo" in decoded(n, shared) for n in shared.nodes) == 1 and len(shared.nodes) == 4
    for i, node in enumerate(shared.nodes):
        above, at = [], node.parent
        while at >= 0:
            above.append(at)
            at = shared.nodes[at].parent
        # the intervals [start, reach) that a node's tokens lie in are its ancestors' and its own
        assert [j for j, n in enumerate(shared.nodes) if n.start <= node.start < n.reach] == sorted([*above, i])
        assert node.position == sum(shared.nodes[j].end - shared.nodes[j].start for j in above)
        assert shared.positions[node.start : node.end] == list(range(node.position, node.position + node.end - node.start))
        assert (node.loss_start is None) == (not decoded(node, shared).endswith(" </s>"))
        if node.loss_start is not None:
            assert decoder(PATH)(shared.tokens[node.loss_start : node.loss_end]) in (b"yo", b"no")
    assert len({r.leaf for r in places.collect() if r.conv_id in (1, 4)}) == 1


def read(spark, rows):
    trees, places = grown(spark, rows)
    back = {bytes(r.leaf): r for r in chat_tree.read_back(trees, places, PATH).collect()}
    return [(r.conv_id, back[bytes(r.leaf)]) for r in places.collect()]


def test_chat_defined_cases(spark):
    rows = read(spark, CHAT)
    found = dict(rows)
    assert [(t.role, t.text) for t in found[5].turns] == [("tool", ""), ("", "x")]
    assert [(t.role, t.text) for t in found[6].turns] == [("user", "a")] * 2
    assert sorted([(t.role, t.text) for t in f.turns] for c, f in rows if c is None) == [[("assistant", "")], [("user", "q")]]
    assert found[2].loss == "no" and found[3].loss == "" and found[7].turns[0].text == "<|endoftext|> \\ [INST]"
    trees, places = grown(spark, [])
    assert trees.count() == places.count() == 0


def as_given(rows, i):
    return [(r[2], r[3]) for r in rows if r[0] == i]


def test_hot_beginnings_are_a_trunk(spark, monkeypatch):
    monkeypatch.setattr(chat_tree, "TREE", 4)
    rows = [(i, t, ("user", "assistant")[t % 2], "same" if t < i % 3 else f"{i}-{t}") for i in range(60) for t in range(4)] + [(100, 0, "user", "same")]
    trees, places = grown(spark, rows)
    texts = [decoded(n, t) for t in trees.collect() for n in t.nodes]
    assert texts.count("[INST] same [/INST]") == texts.count(" same </s>") == 1 and max(len(t.leaves) for t in trees.collect()) <= 8
    assert all([(t.role, t.text) for t in f.turns] == as_given(rows, c) for c, f in read(spark, rows))
    by_id = {bytes(t.tree): t for t in trees.collect()}
    for t in by_id.values():  # positions run on from the trunk
        base, above = 0, t.above
        while above is not None:
            base, above = base + len(by_id[bytes(above)].tokens), by_id[bytes(above)].above
        assert all(n.position == base for n in t.nodes if n.parent < 0)


@pytest.mark.parametrize("n", [300, 20_000])
def test_one_system_turn_stands_once(spark, n):
    rows = spark.range(n).selectExpr("id AS conv_id", "explode(array(0L, 1L)) AS turn").selectExpr("conv_id", "turn", "if(turn = 0, 'system', 'user') AS role", "if(turn = 0, 'shared words', concat('own ', conv_id)) AS text")
    trees, places = chat_tree.chat_trees(rows, PATH)
    trees = trees.cache()
    system = chat_tree.encoder(PATH, True)("shared words").tolist()
    holders = [t for t in trees.where(F.size("leaves") == 0).collect()]
    assert len(holders) == 1 and str(system)[1:-1] in str(list(holders[0].tokens))
    assert all(t.above == holders[0].tree for t in trees.where(F.size("leaves") > 0).select("above").collect())
    assert trees.select(F.sum(F.size("nodes"))).first()[0] == n + 1 and chat_tree.read_back(trees, places, PATH).where("formatted LIKE '%shared words%own %'").count() == n


def test_a_very_long_conversation(spark):
    rows = [(i, t, ("user", "assistant")[t % 2], f"turn {t}" if t < 15_000 else f"{i}") for i in range(2) for t in range(15_001)]
    trees, _ = grown(spark, rows)
    assert sorted(len(t.nodes) for t in trees.collect()) == [15_002]
    assert all([(t.role, t.text) for t in f.turns] == as_given(rows, c) for c, f in read(spark, rows))


# --- pipeline ---

def test_pipeline_stages(spark, tmp_path):
    """Every stage against what it must do, on a small table with planted cases."""
    leak, card = words(900, 30), "4111111111111111"
    rows = [(i, f"the of and in {words(i, 60)} the house is of the", "en", "s", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " more", None, "s", 0), (102, f"{words(800, 20)} {leak} {words(801, 20)}", "en", "s", 0), (103, f"card {card} of the {words(700, 40)}", "en", "s", 0),
             (104, "12345 !!! ???", "en", "s", 0), (105, None, "en", "s", 0), (106, "", None, None, None), (None, words(600, 50), "en", None, 0), (107, words(500, 30_000), "en", "s", 0), (7, rows[7][1], "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, lang_pred string")
    (tmp_path / "d").mkdir()
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, before = {}, docs
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"{i}"))
        before = spark.read.parquet(str(tmp_path / f"{i}"))
        if name != "packing":
            assert before.columns == docs.columns
        kept[name] = {r.doc_id: r for r in before.collect()} if name != "packing" else before.collect()
    assert set(kept["language_id"]) == {r[0] for r in rows} - {104, 105, 106} and kept["language_id"][101].lang == "en"
    assert set(kept["ngram_join"]) == set(kept["language_id"]) - {100, 101}
    assert set(kept["decontaminate"]) == set(kept["ngram_join"]) - {102}
    assert card not in kept["pii"][103].text and kept["pii"][103].n_chars == len(kept["pii"][103].text)
    assert all(kept["pii"][d].text == kept["decontaminate"][d].text for d in kept["pii"] if d != 103)
    whole(kept["packing"], {d: r.text for d, r in kept["pii"].items()})


def test_pipeline_of_empty_and_of_the_table(spark, tmp_path):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    none = documents.limit(0)
    for name, function in corpus_pipeline.STAGES:
        found = function(spark, none, DATA)
        assert found.count() == 0
    done = corpus_pipeline.run(spark, DATA)
    ids = {r.doc_id for r in done.select("doc_id").distinct().collect()}
    leaks = {r[0] for r in duckdb.execute(f"SELECT d.doc_id FROM '{DATA}/documents.parquet' d JOIN '{DATA}/benchmark.parquet' b ON contains(d.text, b.text)").fetchall()}
    assert not ids & leaks and len(ids) > 0.7 * documents.count() and json.dumps(sorted(ids)[:1])

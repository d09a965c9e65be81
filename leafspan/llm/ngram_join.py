"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word shingles.  Two documents link when
``100 * |A & B| >= percent * |A | B|``; components of links are returned.

Method.  All shingles have one global order, rare before frequent, from a count
sketch over all documents, which has more counters for more documents, up to a bound.  A set of n shingles can lack at most
``t = n - ceil(percent * n / 100)`` of its own in a partner.  Its prefix is
extended, in that order, until the places it offers exceed t: a rare shingle is
one place and is indexed alone; frequent shingles fall into groups by hash, and
those of a group are indexed as k-combinations (k = 2, and 3 for the most
frequent class), where the first k - 1 of a group offer no place.  With more than
t places at most t can miss, so some group holds k shared shingles, or a shared
rare shingle: linked sets share an indexed key.  Keys also carry a size band, and
a set near a band's lower end is indexed in the band below too.

A key with few documents yields its pairs, less those whose sizes or parity
bitmaps exclude a link (the bitmaps' Hamming distance never exceeds the symmetric
difference, so no link is lost); a key with more than LIST documents becomes a
star around its smallest, linear in the postings.  Only sets in one component of
these edges are compared: exactly, by blocked matrix products of bounded size,
and only spanning edges leave a block, never all pairs.  Exact copies collapse to
one set before.

Defined cases: null text, or text without words, has no shingles and links with
nothing (component_id is its own doc_id); a text with fewer than k words is one
shingle; rows that share a doc_id count as one node, each with its own
n_shingles; a row without doc_id takes the component of equal sets, or null;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import TASKS, blob_rows, components, input_bytes, parts, shared_dir, sliced, small, stage, swept, unblob, unstage

#: Counters of the sketch that orders shingles, at least and at most (as powers of two), and bytes of input for each: with more shingles a counter, rare ones could not be told from frequent ones.
SKETCH_BITS, SKETCH_BITS_MOST, SKETCH_EACH = 20, 26, 512
#: Estimated documents above which shingles are indexed in pairs, and in triples.
FREQUENT, VERY_FREQUENT = 64, 4096
#: Documents of a key up to which its pairs are taken; longer lists become stars.
LIST = 32
#: Sets, and shingles, of one block of the verification.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
#: Sets of a group up to which groups are verified many at once.
FEW = 16


def _sets(batch: pa.RecordBatch, k: int, text: str = "text"):
    """(row, sorted distinct shingles) of each row of a batch."""
    data, offsets = ts.utf8(batch.column(text))
    for at, to in ts.blocks(offsets):
        hashes, runs = ts.shingles(*ts.word_hashes(*ts.bytes_slice(data, offsets, at, to)), k)
        ends = np.cumsum(runs)
        for i in range(to - at):
            yield at + i, np.unique(hashes[ends[i] - runs[i] : ends[i]])


def sketch_bits(size: int) -> int:
    """The sketch's counters, as a power of two, for so many bytes of input; unknown sizes get the least."""
    return SKETCH_BITS if size >= 1 << 60 else min(max(SKETCH_BITS, (size // SKETCH_EACH).bit_length()), SKETCH_BITS_MOST)


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles occur, by the top bits of their hash, over all documents; 65535 is that or more."""
    per, bits = 1 << 14, sketch_bits(input_bytes(docs))

    def planes(counts: np.ndarray) -> bytes:
        """The counters' bytes, all lowest ones first: the others are nearly all 0 and pack well."""
        return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()

    def count(batches):
        total, any_ = np.zeros(1 << bits, np.uint32), False
        for batch in batches:
            data, offsets = ts.utf8(batch.column("text"))
            for at, to in ts.blocks(offsets):
                found = ts.shingles(*ts.word_hashes(*ts.bytes_slice(data, offsets, at, to)), k)[0]
                np.add.at(total, (found >> ts.U64(64 - bits)).astype(np.int64), np.uint32(1))
                any_ |= len(found) > 0
        for b in range(0, len(total) // per if any_ else 0, 64):
            own = range(b, min(b + 64, len(total) // per))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([planes(total[i * per : (i + 1) * per]) for i in own], pa.binary())], ["b", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(batch.column("b").to_pylist(), batch.column("counts").to_pylist()):
                own = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view("<u4").ravel()
                sums[b] = sums.get(b, 0) + own.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 65535).astype("<u2").tobytes() for v in sums.values()], pa.binary())], ["b", "counts"])

    schema, out = "b int, counts binary", np.zeros(1 << bits, np.uint16)
    with swept(docs.sparkSession):
        for b, counts in docs.select("text").mapInArrow(count, schema).repartition("b").mapInArrow(add, schema).collect():
            out[b * per : (b + 1) * per] = np.frombuffer(counts, "<u2")
    return out


def _keys(tokens: np.ndarray, often: np.ndarray, missing: int, floor: int) -> list[np.ndarray]:
    """Index keys of one set in one size band; tokens in global order, floor the band's smallest size."""
    need = missing + 1
    if floor < 16 or often[min(need, len(often)) - 1] <= FREQUENT:
        return [tokens[:need]]
    groups2, groups3 = floor // 8, floor // 16
    rare = int(np.searchsorted(often, FREQUENT, "right"))
    got, held, at = min(rare, need), {}, min(rare, need)
    while got < need and at < len(tokens):
        k = 3 if often[at] > VERY_FREQUENT else 2
        group = held.setdefault((k, int(tokens[at] % ts.U64(groups3 if k == 3 else groups2))), [])
        group.append(at)
        got += len(group) >= k
        at += 1
    out = [tokens[: min(rare, need)]]
    for (k, _), group in held.items():
        if len(group) >= k:
            combos = np.array(list(itertools.combinations(sorted(group, key=lambda i: tokens[i]), k)))
            key = np.full(len(combos), k, np.uint64)
            for j in range(k):
                key = ts.mix(key * ts.U64(0x9E3779B97F4A7C15) + tokens[combos[:, j]])
            out.append(key)
    return out


def _parity(tokens: np.ndarray, percent: int = 50) -> np.ndarray:
    """One bit for each residue of the tokens: whether an odd number of them falls there; three bits at least for each token that may differ, two for each at most.

    The halves of a bitmap, one upon the other by exclusive or, are the bitmap of half the size.
    """
    differ = len(tokens) * 3 * (100 - percent) // (100 + percent)
    bits = 64 << max(0, (differ >> 5).bit_length())
    odd = np.bincount((tokens >> ts.U64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sums(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    return (int(np.bitwise_xor.reduce(tokens)), int(np.add.reduce(ts.mix(tokens)))) if len(tokens) else (0, 0)


def _scan(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A document, its size, the hash of its set, the first document of its batch with that set, and its bitmap."""
    def scan(batches):
        for batch in sliced(batches, "text", 8 << 20):
            ids = batch.column("doc_id").to_pylist()
            rows, seen = [], {}
            for row, tokens in _sets(batch, k):
                n, doc, (s1, s2) = len(tokens), ids[row], _sums(tokens)
                rows.append((doc, n, s1, s2, _parity(tokens, percent)))
                if n and doc is not None:
                    seen.setdefault((s1, s2, n), doc)
            as_long = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), as_long([r[2] for r in rows]), as_long([r[3] for r in rows]), pa.array([seen.get((r[2], r[3], r[1]), r[0]) for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]).astype(np.int32)), as_long(np.concatenate([np.zeros(0, np.uint64), *(r[4] for r in rows)])))],
                                             ["doc_id", "n", "s1", "s2", "leader", "bits"])

    return docs.mapInArrow(scan, "doc_id long, n long, s1 long, s2 long, leader long, bits array<long>")


def _postings(docs: DataFrame, k: int, percent: int, n_parts: int) -> DataFrame:
    """Packed (key, document, size) postings by part, of one document for each set of a batch.

    The texts are read once more for them, so that they are shuffled without being stored before.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k))

    def scan(batches):
        counts = sketch.value
        noise, bits = int(counts.mean()), len(counts).bit_length() - 1
        for batch in sliced(batches, "text", 8 << 20):
            ids = batch.column("doc_id").to_pylist()
            keys, owners, sizes, seen = [], [], [], set()
            for row, tokens in _sets(batch, k):
                n, doc, sums = len(tokens), ids[row], _sums(tokens)
                if not n or doc is None or (*sums, n) in seen:
                    continue
                seen.add((*sums, n))
                often = np.maximum(counts[(tokens >> ts.U64(64 - bits)).astype(np.int64)].astype(np.int64) - noise, 0)
                order = np.lexsort((tokens, often))
                tokens, often = tokens[order], often[order]
                missing, band = n - -(-percent * n // 100), n.bit_length() - 1
                for b in (band, band - 1) if -(-percent * n // 100) < 1 << band else (band,):
                    for key in _keys(tokens, often, missing, 1 << b):
                        keys.append(ts.mix(key + ts.U64(b)))
                        owners.append(np.full(len(key), doc, np.int64))
                        sizes.append(np.full(len(key), n, np.int64))
            if keys:
                key = np.concatenate(keys)
                blobs = list(blob_rows(key, [key, np.concatenate(owners), np.concatenate(sizes)], n_parts))
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], ["part", "blob"])

    return docs.mapInArrow(scan, "part int, blob binary")


def key_edges(postings: DataFrame, percent: int) -> DataFrame:
    """Edges between the holders of a key; postings: packed (key, holder, size) records by part.

    Pairs (a < b) of short lists, star = 0, and stars around the smallest document of long ones, star = 1."""
    def edges(table: pa.Table) -> pa.Table:
        rows = unblob(table.column("blob").to_pylist(), 3)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        length = np.diff(np.r_[first, len(rows)])
        out = []
        long = length > LIST
        hub = np.repeat(rows[first[long], 1], length[long])
        out.append(np.stack([hub, rows[np.repeat(long, length), 1], np.ones(len(hub), np.int64)], axis=1))
        left = np.repeat(np.where(long, 0, length), length) - (np.arange(len(rows)) - np.repeat(first, length))
        for step in range(1, LIST):
            at = np.flatnonzero(left > step)
            if not len(at):
                break
            x, y = rows[at], rows[at + step]
            fits = (100 * x[:, 2] >= percent * y[:, 2]) & (100 * y[:, 2] >= percent * x[:, 2])
            out.append(np.stack([x[fits, 1], y[fits, 1], np.zeros(int(fits.sum()), np.int64)], axis=1))
        pairs = np.concatenate(out)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "star": pa.array(pairs[:, 2])})

    return postings.groupBy("part").applyInArrow(edges, "a long, b long, star long")


def _links(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning edges of the links between sets, across sides if there are two."""
    m, sizes = len(ids), np.array([len(s) for s in sets])
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    keep = times[where] > 1
    row, column = row[keep], (np.cumsum(times > 1) - 1)[where[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared, width = np.zeros((m, m), np.float32), 2048
    for at in range(0, int(times[times > 1].size), width):
        s, e = np.searchsorted(column, (at, at + width))
        part = np.zeros((m, width), np.float32)
        part[row[s:e], column[s:e] - at] = 1
        shared += part @ part.T
    both, sizes = shared.astype(np.int32), sizes.astype(np.int32)
    del shared
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if sides.min() != sides.max():
        linked &= sides[:, None] != sides[None, :]
    left, out = np.ones(m, bool), []
    for i in range(m):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                at = todo.pop()
                for j in np.flatnonzero(linked[at] & left).tolist():
                    left[j] = False
                    out.append((int(ids[at]), int(ids[j])))
                    todo.append(j)
    return out


def _whole_groups(batches, keys: list[str]):
    """Sorted Arrow batches as tables that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, at: tuple(batch.column(k)[at].as_py() for k in keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last == 0 and held and key(held[-1], 0) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _group_links(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups (component, i, j) of a table: small groups all at once, each of the others by itself."""
    table = table.combine_chunks()
    component, i, j, node, block = (table.column(c).to_numpy() for c in ("component", "i", "j", "node", "block"))
    tokens = table.column("tokens").combine_chunks()
    offsets, values = tokens.offsets.to_numpy().astype(np.int64), tokens.values.to_numpy().view(np.uint64)
    new = np.r_[True, (component[1:] != component[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(node)])
    small = (size <= FEW) & (i[begin] == j[begin])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.flatnonzero(np.repeat(small & (size > 1), size))
    for at in range(0, len(rows), 1 << 14):  # groups may be cut here, so take them to their end
        lo, hi = (np.searchsorted(begin, rows[x], "right") - 1 if x < len(rows) else len(begin) for x in (at, at + (1 << 14)))
        own = rows[np.searchsorted(rows, begin[lo]) : np.searchsorted(rows, begin[hi]) if hi < len(begin) else len(rows)]
        n = offsets[own + 1] - offsets[own]
        token = values[np.repeat(offsets[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        owner = np.repeat(own, n)
        group = (np.cumsum(new) - 1)[owner]
        order = np.lexsort((owner, token, group))
        owner, token, group = owner[order], token[order], group[order]
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])][: len(token)])
        length = np.diff(np.r_[first, len(token)])
        left = np.repeat(length, length) - (np.arange(len(token)) - np.repeat(first, length))
        pairs = [np.zeros(0, np.int64)]
        for step in range(1, FEW):
            here = np.flatnonzero(left > step)
            if not len(here):
                break
            pairs.append(owner[here] * len(node) + owner[here + step])
        pair, both = np.unique(np.concatenate(pairs), return_counts=True)
        x, y = pair // len(node), pair % len(node)
        linked = 100 * both >= percent * (offsets[x + 1] - offsets[x] + offsets[y + 1] - offsets[y] - both)
        a.append(node[x[linked]])
        b.append(node[y[linked]])
    for g in np.flatnonzero(~small).tolist():
        s, e = int(begin[g]), int(begin[g] + size[g])
        if e - s > 1:
            edges = np.array(_links(node[s:e], [values[offsets[r] : offsets[r + 1]] for r in range(s, e)], block[s:e], percent), np.int64).reshape(-1, 2)
            a.append(edges[:, 0])
            b.append(edges[:, 1])
    return np.concatenate(a), np.concatenate(b)


def with_blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (node, component, n) with the number of blocks their component is verified in."""
    size = nodes.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # staged, so that the join on a large component can be split
    return nodes.join(stage(size, "sizes"), "component")


def verify_sets(sets: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """Edges (a, b) that span the links within components; sets: (node, component, blocks, tokens), tokens sorted and distinct.

    A component larger than a block is verified block by block and block pair by
    block pair, each in a group of bounded size.
    """
    def verify(batches):
        for table in _whole_groups(batches, ["component", "i", "j"]):
            a, b = _group_links(table, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = (sets.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "tokens"))
    keys = ["component", "i", "j"]
    return dealt.repartition(min(n_parts, TASKS), *keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long")


def _verified(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified spanning edges within candidate components; nodes: (node, component, n), one row each."""
    nodes = stage(with_blocks(nodes).select("node", "component", "blocks"), "nodes")
    texts = docs.join(small(nodes), docs.doc_id == nodes.node).select("node", "component", "blocks", "text")

    def sets(batches):
        for batch in sliced(batches, "text"):
            found = [s for _, s in _sets(batch, k)]
            tokens = pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), batch.column("blocks"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in found])].astype(np.int32)), tokens)], ["node", "component", "blocks", "tokens"])

    return verify_sets(texts.mapInArrow(sets, "node long, component long, blocks int, tokens array<long>"), percent, parts(docs))


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; see the module for the method and the defined cases."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    shared_dir(docs.sparkSession)
    scanned = stage(_scan(docs, k, percent), "scan")
    # equal sets of a batch follow its leader, and leaders the first of them: no step meets all copies of a set at once
    sets = scanned.select("doc_id", "n", "s1", "s2", "leader")
    leaders = sets.where("n > 0 and leader = doc_id").select("leader", "n", "s1", "s2").distinct()
    classes = stage(leaders.groupBy("n", "s1", "s2").agg(F.min("leader").alias("rep")), "classes")
    reps = stage(leaders.join(classes, ["n", "s1", "s2"]).select("leader", "n", "s1", "s2", "rep"), "reps")
    led = sets.where("leader is not null").join(reps, ["leader", "n", "s1", "s2"], "left")
    alone = sets.where("leader is null").join(classes, ["n", "s1", "s2"], "left")
    members = stage(led.select("doc_id", "n", "rep").union(alone.select("doc_id", "n", "rep")).select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    unstage(classes, reps)
    starred = edges = stage(key_edges(_postings(docs, k, percent, parts(docs, 4 << 20)), percent), "edges")
    moved = stage(members.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("rep")), "moved")
    hinted = small(moved)
    for c in ("a", "b"):
        edges = edges.join(hinted, edges[c] == hinted.doc_id, "left").withColumn(c, F.coalesce("rep", c)).select("a", "b", "star")
    edges = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("star").alias("star"))
    bits = scanned.groupBy("doc_id").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.countDistinct("s1", "s2").alias("sets"))
    x, y = (bits.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"), F.col("sets").alias(f"sets{c}")) for c in "ab")
    # sizes that may link differ by less than a factor of two, so one fold makes bitmaps equally long
    half = lambda c: F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    fit = lambda c, o: F.when(F.size(c) > F.size(o), half(c)).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(fit("bitsa", "bitsb"), fit("bitsb", "bitsa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    near = edges.where("star = 0").join(x, "a").join(y, "b").where((apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)) | (F.col("setsa") > 1) | (F.col("setsb") > 1))
    candidates = components(edges.where("star = 1").select("a", "b").union(near.select("a", "b")))
    unstage(scanned, starred, moved)
    sizes = members.where("doc_id = rep").groupBy("doc_id").agg(F.max("n").alias("n"))
    nodes = candidates.join(sizes, candidates.node == sizes.doc_id).select("node", "component", "n")
    # rows that share a doc_id are one node, so equal sets of different nodes are links too
    same = members.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = members.groupBy("doc_id").agg(F.countDistinct("rep").alias("reps")).where("reps > 1").select("doc_id")
    found = components(_verified(docs, nodes, k, percent).union(same.join(repeated, same.a == repeated.doc_id, "left_semi")))
    return (members.join(found, members.rep == found.node, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

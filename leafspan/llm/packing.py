"""Lexical retrieval packing of documents into windows of tokens.

Every document becomes its token ids and one end id, staged by windows: a row holds one
window's ids at most, however long the text.  Full windows of a long document are
sequences of their own, numbered below zero, and are not shuffled; what is left of each
document is packed with similar leftovers.  Leftovers are dealt to shards, and in a shard an inverted index over their
tokens answers BM25 queries: each seed, longest first, asks for its unused neighbours,
which fill its window in rank order as far as they fit; the best that does not fit is
cut to fill it, and its rest stays unused.  So only the last window of a shard can have
padding.  Seeds without neighbours take the next unused leftover.

BM25's statistics (documents, their mean length and how many hold a token) are counted
over all leftovers; there is one number a token, whatever the number of documents.  All
tokens score: those that more than one in STOP leftovers of a shard hold by a matrix
product, the others by postings.

Shards hold similar documents, so that a seed's neighbours lie in its own.  Each
leftover is a vector of DIM numbers, its tokens' rarities added by hash.  A tree of
k-means splits, fitted on about SAMPLE leftovers, deals all of them to leaves; a leaf
that the sample cannot split further is dealt by each leftover's rarest token, so copies
still meet.  What lands in one place is counted for all documents, and more than SHARD of
them (copies, equal rows) are dealt on by row.  So a shard's size is bounded whatever
the number of documents and however many are equal.

Defined cases: null text is empty and leaves the end id alone; documents with equal or
null doc_id are packed each on its own; a text of any length is read whole; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import ROWS, TASKS, grouped, parts, shared_dir, sliced, small, stage
from .tokens import encoder, vocabulary

WINDOW, SHARD, STOP, RANKED = 1024, 2048, 8, 32
#: Leftovers that the tree of splits is fitted on, the least of them behind a centre, and the numbers of a vector.
SAMPLE, LEAF, DIM = 16_384, 16, 256
#: Children of a split at most.
FAN = 32
#: BM25's usual constants.
K1, B = 1.2, 0.75


def _held(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, leftover and count of each token that a leftover holds, by token and leftover."""
    owner = np.repeat(np.arange(len(rests)), [len(r) for r in rests])
    key, times = np.unique(np.concatenate([np.zeros(0, np.int64), *rests]).astype(np.int64) * max(len(rests), 1) + owner, return_counts=True)
    return key // max(len(rests), 1), key % max(len(rests), 1), times


class Statistics:
    """What BM25 needs of all leftovers: how many, their mean length, and of each token how many hold it."""

    def __init__(self, documents: int, tokens: int, held: np.ndarray):
        self.documents, self.mean = documents, max(tokens / max(documents, 1), 1e-9)
        self.held = held.astype(np.float32)

    @classmethod
    def of(cls, rests: list[np.ndarray], size: int) -> Statistics:
        token, _, _ = _held(rests)
        return cls(len(rests), sum(map(len, rests)), np.bincount(token, minlength=size))

    def weights(self, token: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        held = self.held[token]
        idf = np.log1p((self.documents - held + 0.5) / (held + 0.5))
        return (idf * times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean))).astype(np.float32)


def _index(rests: list[np.ndarray], statistics: Statistics):
    """Postings of a shard's leftovers: (first and count by token number, leftovers, weights), each leftover's token numbers, and scores by frequent tokens."""
    sizes = np.array([len(r) for r in rests])
    token, doc, times = _held(rests)
    weight = statistics.weights(token, times, sizes[doc])
    _, number, held = np.unique(token, return_inverse=True, return_counts=True)
    often = (held * STOP > len(rests)) & (held > 1)
    column = np.cumsum(often) - 1
    dense = np.zeros((len(rests), int(often.sum())), np.float32)
    here = often[number]
    dense[doc[here], column[number[here]]] = weight[here]
    scores = (dense > 0).astype(np.float32) @ dense.T
    keep = (held[number] > 1) & ~here
    number, doc, weight = number[keep], doc[keep], weight[keep]
    first = np.searchsorted(number, np.arange(len(held)))
    count = np.diff(np.r_[first, len(number)])
    order = np.argsort(doc, kind="stable")
    return first, count, doc, weight, number[order], np.searchsorted(doc[order], np.arange(len(rests) + 1)), scores


def pack_shard(rests: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of (leftover, from, to) pieces that together hold every leftover's ids once."""
    n = len(rests)
    if not n:
        return []
    statistics = statistics or Statistics.of(rests, int(max((r.max() for r in rests if len(r)), default=0)) + 1)
    first, count, docs, weights, terms, of, dense = _index(rests, statistics)
    at, size = np.zeros(n, np.int64), np.array([len(r) for r in rests])
    unused = size > 0
    seeds = np.argsort(-size, kind="stable")
    waiting, windows = 0, []
    while True:
        while waiting < n and not unused[seeds[waiting]]:
            waiting += 1
        if waiting == n:
            return windows
        seed = int(seeds[waiting])
        own, room = [(seed, int(at[seed]), int(size[seed]))], window - int(size[seed] - at[seed])
        unused[seed] = False
        while room:
            query = terms[of[seed] : of[seed + 1]]
            lengths = count[query]
            entry = np.repeat(first[query] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            score = np.bincount(docs[entry], weights[entry], n) + dense[seed]
            score[~unused] = -1
            best = np.argpartition(-score, RANKED)[:RANKED] if n > RANKED else np.arange(n)
            best = best[score[best] >= 0]
            best = best[np.lexsort((best, -score[best]))]
            if not len(best):
                break
            cut = None
            for doc in best.tolist():
                left = int(size[doc] - at[doc])
                if left <= room:
                    own.append((doc, int(at[doc]), int(size[doc])))
                    unused[doc] = False
                    room -= left
                    if not room:
                        break
                elif cut is None:
                    cut = doc
            if room and cut is not None:
                own.append((cut, int(at[cut]), int(at[cut]) + room))
                at[cut] += room
                room = 0
        windows.append(own)


def _rests(batch: pa.RecordBatch, window: int) -> list[np.ndarray]:
    """The ids behind the full windows of each row."""
    out = []
    for n, body in zip(batch.column("n").to_pylist(), batch.column("ids")):
        ids = np.frombuffer(body.as_buffer(), "<u2" if len(body.as_buffer()) == 2 * n else "<u4")
        out.append(ids[n // window * window :])
    return out


def _vectors(rests: list[np.ndarray], statistics: Statistics) -> tuple[np.ndarray, np.ndarray]:
    """A vector of length one for each leftover, by the rarity of its tokens, and its rarest token."""
    size = len(statistics.held)
    hashed = ts.mix(np.arange(1, size + 1, dtype=np.uint64))
    worth = np.log1p((statistics.documents - statistics.held + 0.5) / (statistics.held + 0.5)) * np.where(hashed >> ts.U64(63), 1.0, -1.0)
    lengths = np.array([len(r) for r in rests])
    tokens = np.concatenate([np.zeros(0, np.int64), *rests]).astype(np.int64)
    at = np.repeat(np.arange(len(rests)) * DIM, lengths) + (hashed % ts.U64(DIM)).astype(np.int64)[tokens]
    out = np.bincount(at, worth[tokens], len(rests) * DIM).reshape(-1, DIM).astype(np.float32)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    rarest, some = np.zeros(len(rests), np.int64), np.flatnonzero(lengths)
    if len(some):
        key = statistics.held.astype(np.int64)[tokens] << 32 | tokens
        rarest[some] = np.minimum.reduceat(key, (np.cumsum(lengths) - lengths)[some]) & 0xFFFFFFFF
    return out, rarest


class Tree:
    """Splits by the nearest of some centres; ``leaf`` deals vectors to leaves, ``shares`` says into how many a leaf's documents are dealt on."""

    def __init__(self, sample: np.ndarray, documents: int):
        self.centres, self.child, self.number, self.shares = [], [], [], []
        each, rng = documents / max(len(sample), 1), np.random.default_rng(11)
        todo = [np.arange(len(sample))]
        for own in todo:  # grows while it is read
            k = int(min(FAN, np.ceil(1.5 * len(own) * each / SHARD), len(own) // LEAF))
            split = self._split(sample[own], k, rng) if len(own) * each > SHARD and k > 1 else None
            self.centres.append(split and split[0])
            self.child.append(len(todo) if split else -1)
            self.number.append(-1 if split else len(self.shares))
            if split:
                todo += [own[split[1] == c] for c in range(len(split[0]))]
            else:
                self.shares.append(max(1, int(np.ceil(len(own) * each / SHARD))))
        self.child, self.number, self.shares = np.array(self.child), np.array(self.number), np.array(self.shares)

    @staticmethod
    def _split(own: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray] | None:
        """k-means by the cosine, from centres far from each other; centres with fewer than LEAF are given up."""
        centres, near = own[rng.integers(len(own), size=1)], np.full(len(own), -1.0)
        for _ in range(k - 1):
            near = np.maximum(near, own @ centres[-1])
            away = np.cumsum(np.maximum(1 - near, 0) ** 2)
            if away[-1] <= 1e-9:
                break
            centres = np.vstack([centres, own[min(int(np.searchsorted(away, rng.random() * away[-1], "right")), len(own) - 1)]])
        for step in range(12):
            nearest = np.argmax(own @ centres.T, axis=1)
            size = np.bincount(nearest, minlength=len(centres))
            kept = np.flatnonzero(size >= (LEAF if step > 3 else 1))
            if len(kept) < 2:
                return None
            centres = np.array([own[nearest == c].mean(axis=0) for c in kept])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        nearest = np.argmax(own @ centres.T, axis=1)
        return centres.astype(np.float32), nearest

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(self.child[node] >= 0)
            if not len(inner):
                return self.number[node]
            for at in np.unique(node[inner]):
                own = inner[node[inner] == at]
                node[own] = self.child[at] + np.argmax(vectors[own] @ self.centres[at].T, axis=1)


def _statistics(held: DataFrame, window: int, size: int) -> Statistics:
    per = 1 << 14

    def count(batches):
        total, documents, tokens = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            rests = _rests(batch, window)
            total += np.bincount(_held(rests)[0], minlength=size)
            documents, tokens = documents + len(rests), tokens + sum(map(len, rests))
        rows = [(-1, np.array([documents, tokens]).astype("<i8").tobytes()), *((b, total[b * per : (b + 1) * per].astype("<i8").tobytes()) for b in range(-(-size // per)))] if documents else []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["b", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(batch.column("b").to_pylist(), batch.column("counts").to_pylist()):
                sums[b] = sums.get(b, 0) + np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["b", "counts"])

    kind, found, totals = "b int, counts binary", np.zeros(size, np.int64), np.zeros(2, np.int64)
    for b, counts in held.select("n", "ids").mapInArrow(count, kind).repartition("b").mapInArrow(add, kind).collect():
        counts = np.frombuffer(counts, "<i8")
        if b < 0:
            totals = counts
        else:
            found[b * per : b * per + len(counts)] = counts
    return Statistics(int(totals[0]), int(totals[1]), found)


def deal(held: DataFrame, statistics: Statistics, window: int = WINDOW) -> DataFrame:
    """``held`` (doc_id, n, ids) with the shard of each row, a number from 0 below 2 ** 36."""
    spark = held.sparkSession

    def sampled(batches):
        for batch in batches:
            vectors, _ = _vectors(_rests(batch, window), statistics)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary())], ["v"])

    chosen = held.select("n", "ids").where(F.rand(5) < SAMPLE / max(statistics.documents, 1)).mapInArrow(sampled, "v binary").collect()
    tree = Tree(np.frombuffer(b"".join(sorted(r.v for r in chosen)), np.float32).reshape(-1, DIM), statistics.documents)
    shared = spark.sparkContext.broadcast((tree, statistics))

    def place(batches):
        tree, statistics = shared.value
        for batch in batches:
            vectors, rarest = _vectors(_rests(batch, window), statistics)
            leaf = tree.leaf(vectors)
            share = (ts.mix(rarest.astype(np.uint64)) % tree.shares[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf * int(tree.shares.max()) + share), *(batch.column(c) for c in batch.schema.names)], ["place", *batch.schema.names])

    kinds = ", ".join(f"{c} {t}" for c, t in held.dtypes)
    placed = held.mapInArrow(place, f"place long, {kinds}")
    sizes = held.select("n", "ids").mapInArrow(place, "place long, n long, ids binary").groupBy("place").agg(F.ceil(F.count("*") / SHARD).alias("chunks"))
    sizes = stage(sizes.where("chunks > 1"), "sizes")
    most = (sizes.agg(F.max("chunks")).first()[0] or 1)
    chunk = F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("row"), "chunks")).otherwise(0)
    # a row's number depends on the files of the staged table alone
    placed = placed.withColumn("row", F.monotonically_increasing_id()).join(small(sizes), "place", "left")
    return placed.select((F.col("place") * most + chunk).alias("shard"), *held.columns)


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    shared_dir(df.sparkSession)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def tokens(batches):
        encode = encoder(tokenizer_path)
        for batch in sliced(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id))
                ids = ids.astype("<u2") if int(ids.max()) < 1 << 16 else ids.astype("<u4")
                rows += [(doc, len(ids), at, len(part), part.tobytes()) for at in range(0, len(ids), window) for part in [ids[at : at + window]]]
            for at in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + ROWS]), (*[pa.int64()] * 4, pa.binary()))], ["doc_id", "total", "start", "n", "ids"])

    held = stage(docs.mapInArrow(tokens, "doc_id long, total long, start long, n long, ids binary"), "tokens")
    rests = held.where(F.col("n") < window)
    statistics = _statistics(rests, window, max(vocabulary(tokenizer_path), end_id + 1))
    shared = df.sparkSession.sparkContext.broadcast(statistics)

    def widen(batches):
        for batch in batches:
            ids = [np.frombuffer(body, "<u2" if len(body) == 2 * window else "<u4").astype("<u4").tobytes() for body in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(ids, pa.binary()), batch.column("total")], ["doc_id", "start", "length", "ids", "doc_tokens"])

    def fill(batches):
        for (shard,), slices in grouped(batches, ["shard"]):
            rows = []
            for batch in slices:
                for doc, total, start, n, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "total", "start", "n", "ids"))):
                    rows.append((doc is not None, doc or 0, total, start, n, body))
            rows.sort()
            ids = [np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4") for *_, n, body in rows]
            out, sequence = [], int(shard) << 26
            for pieces in pack_shard(ids, window, shared.value):
                offset = 0
                for r, s, e in pieces:
                    out.append((r, s, e, sequence, offset))
                    offset += e - s
                sequence += 1
            for at in range(0, len(out), 1024):
                part = out[at : at + 1024]
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[r][1] if rows[r][0] else None for r, *_ in part], pa.int64()), pa.array([rows[r][3] + s for r, s, *_ in part], pa.int64()), pa.array([e - s for _, s, e, *_ in part], pa.int64()),
                    pa.array([ids[r][s:e].astype("<u4").tobytes() for r, s, e, *_ in part], pa.binary()), pa.array([rows[r][2] for r, *_ in part], pa.int64()), pa.array([p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    piece = "doc_id long, start long, length long, ids binary, doc_tokens long"
    shards = deal(rests, statistics, window).repartition(min(parts(held), TASKS), "shard").sortWithinPartitions("shard")
    full = held.where(F.col("n") == window).mapInArrow(widen, piece)
    # a row's number depends on the files of the staged table alone
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return shards.mapInArrow(fill, f"{piece}, sequence_id long, offset long").unionByName(full)


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Exact substring deduplication by bucket-pointer refinement.

Every byte covered by a LENGTH-byte string that also starts earlier (in a document
with a smaller id, or earlier in the same one) is removed; strings never cross
documents and are judged on the input.

Method.  Positions start in buckets named by a q-gram: of the q-grams inside a
LENGTH-byte string, the one with the least hash, leftmost on ties.  That choice
depends on the string alone, so equal strings share a bucket, and neighbouring
positions mostly share one occurrence, so a run of up to LENGTH - Q + 1 positions
is one record.  Runs with the content of an earlier one are settled at once.  The
first runs of each content, where their bucket holds several, are fetched with their
bytes and their positions refined: sorted by GRAM-byte buckets first, then bucket by
bucket on the bucket identifiers found at a later offset, which doubles (8, 16, 32, 64
bytes).  New identifiers are written in place, so buckets refined later read what
earlier ones have left, and a position alone in its bucket is done.  Neighbours in the
final order are compared byte by byte; of equal LENGTH-byte strings the first by
document and start stays, all others are covered.

Hot buckets.  A q-gram with more than HOT different runs in one batch is hot.  HOT of
its runs mark the bucket, the others are dealt by their content, so no task meets them
all.  Positions of hot buckets are refined by identifiers that double in depth (25, 50,
100 bytes) as 64-bit hashes, dealt by hash.  There, and where whole runs are equal,
strings are told apart by 96 bits of two hashes; elsewhere by their bytes.

Records equal within one batch of rows collapse there, so a bucket holds at most
one record of a content for each batch, however many documents share the string;
texts meet their ranges in parts of bounded size, by document.

Defined cases: null text is empty; texts shorter than LENGTH bytes lose nothing;
a null doc_id sorts first; rows that share a doc_id (or have none) but not the text are
documents of their own, ordered by a hash of their texts; equal rows get equal results
and do not repeat each other; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import parts, shared_dir, sliced, stage

LENGTH, Q = 100, 40
#: Bytes of the first buckets of the refinement; buckets of one step, by their bytes.
GRAM, STEP_BYTES = 8, 1 << 20
#: Different runs of a q-gram in one batch above which it is hot.
HOT = 8
_NONE = -(1 << 63)
_POSITION = (1 << 21) - 1
#: Bytes scanned at once; longer texts are scanned in pieces that overlap by LENGTH - 1.
_SCAN = 1 << 20
_DEEPER = ts.U64(0xD6E8FEB86659FD93)
#: Records in packed form: bucket, name, document, start, positions (and _FLAG if the bucket is hot).
RECORD = np.dtype([("m", "<u4"), ("h", "<u8"), ("doc", "<i8"), ("own", "<i8"), ("start", "<u4"), ("n", "<u1")])
_FLAG, _COUNT = 128, 127
_PRIME = 2147483647


def _place(docs: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """The part of a document; place_column says the same in SQL."""
    return (docs % _PRIME + own % _PRIME) % _PRIME * 48271 % _PRIME % n


def _place_column(doc, own, n: int):
    return (F.pmod(F.pmod(F.pmod(doc, F.lit(_PRIME)) + F.pmod(own, F.lit(_PRIME)), F.lit(_PRIME)) * 48271, F.lit(_PRIME)) % n).cast("int")


def _pack(records: np.ndarray) -> bytes:
    """Column by column, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(records[f]).tobytes() for f in RECORD.names)


def _unpack(blobs) -> np.ndarray:
    each = []
    for blob in blobs:
        n, at = len(blob) // RECORD.itemsize, 0
        records = np.empty(n, RECORD)
        for f in RECORD.names:
            size = RECORD[f].itemsize * n
            records[f] = np.frombuffer(blob, RECORD[f], n, at)
            at += size
        each.append(records)
    return np.concatenate(each) if each else np.empty(0, RECORD)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, positions, bucket and name of the runs of rows in one block of bytes."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = ts.prefix(data)
    at = np.arange(n - Q + 1)
    grams = ts.span_hash(sums, at, at + Q)
    least = (grams & ts.U64(~_POSITION & 0xFFFFFFFFFFFFFFFF)) | at.astype(np.uint64)
    span, window = 1, LENGTH - Q + 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[: n - LENGTH + 1], least[window - span :][: n - LENGTH + 1])
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    position = np.flatnonzero(np.cumsum(inside[: n - LENGTH + 1]))
    anchor = (least[position] & ts.U64(_POSITION)).astype(np.int64)
    new = np.ones(len(position), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (position[1:] != position[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(position)])
    start = position[first]
    return start, count, grams[anchor[first]], ts.span_hash(sums, start, start + count - 1 + LENGTH)


def _scan_rows(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of all runs of all rows, m the low bits of the bucket, and the whole buckets."""
    pairs = [(np.empty(0, RECORD), np.zeros(0, np.uint64))]
    for at, to in ts.blocks(offsets, _SCAN):
        size = int(offsets[to] - offsets[at])
        for shift in range(0, max(1, size - LENGTH + 1), _SCAN) if size > 2 * _SCAN else (0,):
            if size > 2 * _SCAN:  # one long row
                piece, where = data[offsets[at] + shift : min(offsets[at] + shift + _SCAN + LENGTH - 1, offsets[to])], None
                where = np.array([0, len(piece)])
            else:
                piece, where = ts.bytes_slice(data, offsets, at, to)
            start, count, bucket, name = _runs(piece, where)
            row = np.searchsorted(where, start, "right") - 1
            records = np.empty(len(start), RECORD)
            records["m"], records["h"], records["n"] = bucket.astype(np.uint32), name, count
            records["doc"], records["own"], records["start"] = docs[at + row], own[at + row], start - where[row] + shift
            pairs.append((records, bucket))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _deal(records: np.ndarray, part: np.ndarray):
    """(part, blob) for each part that has records."""
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    if len(part):
        for s, e in zip([0, *cuts], [*cuts, len(part)]):
            yield int(part[s]), _pack(records[s:e])


def _in_order(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by bucket, name and place; which of the ordered are the first of a name, and which stand at the first's place (equal rows)."""
    order = np.lexsort((records["start"], records["own"], records["doc"], records["h"], records["m"]))
    records = records[order]
    new = np.ones(len(records), bool)
    new[1:] = (records["h"][1:] != records["h"][:-1]) | (records["m"][1:] != records["m"][:-1])
    lead = records[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(records) else records
    return order, new, (records["doc"] == lead["doc"]) & (records["own"] == lead["own"]) & (records["start"] == lead["start"])


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def _within(key: np.ndarray) -> np.ndarray:
    """The number of each element among those with its key; equal keys stand together."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))


def _route(records: np.ndarray, key: np.ndarray, n: int):
    """Blobs for the grouping by key (parts 0 to n - 1) and of ranges already known as covered (parts n to 2 n - 1)."""
    order, new, first = _in_order(records)
    records, key = records[order], key[order]
    yield from _deal(records[~first], n + _place(records["doc"][~first], records["own"][~first], n))
    records, key = records[new], key[new]
    by_key = np.lexsort((records["h"], key))
    records, key = records[by_key], key[by_key]
    number = _within(key)
    many = np.isin(key, key[number >= HOT])
    records["n"][many] |= _FLAG
    key = np.where(number >= HOT, records["h"], key)
    yield from _deal(records, (ts.mix(key) % ts.U64(n)).astype(np.int64))


def _ranges(dealt: DataFrame, n: int, refine: bool) -> DataFrame:
    """Covered ranges (kind 1) and, if refine, runs to look into (kind 2), packed by the part of their document."""
    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, blobs = key[0].as_py(), table.column("blob").to_pylist()
        rows = []
        if part >= 2 * n:
            rows = [(p, 1, b) for blob_group in _steps(blobs) for p, b in _deal(blob_group, _place(blob_group["doc"], blob_group["own"], n))]
        elif part >= n:
            rows = [(part - n, 1, b) for b in blobs]
        else:
            records = _unpack(blobs)
            order, new, first = _in_order(records)
            records = records[order]
            rows += [(p, 1, b) for p, b in _deal(records[~first], _place(records["doc"][~first], records["own"][~first], n))]
            if refine and len(records):
                bucket = np.cumsum(np.r_[True, records["m"][1:] != records["m"][:-1]]) - 1
                names = np.bincount(bucket[new])[bucket]
                hot = (np.bincount(bucket, records["n"] & _FLAG) > 0)[bucket]
                records["n"] = records["n"] & _COUNT | np.where(hot, _FLAG, 0).astype(np.uint8)
                leads = records[new & (hot | (names > 1))]
                rows += [(p, 2, b) for p, b in _deal(leads, _place(leads["doc"], leads["own"], n))]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    return dealt.groupBy("part").applyInArrow(settle, "part int, kind int, blob binary")


def _with_bytes(records: np.ndarray, pieces: list[bytes], part: np.ndarray):
    """(part, blob) of runs with their bytes."""
    order = np.argsort(part, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(part)]
    for s, e in zip(cuts, cuts[1:]):
        if e > s:
            yield int(part[order[s]]), (e - s).to_bytes(8, "little") + _pack(records[order[s:e]]) + b"".join(pieces[i] for i in order[s:e])


def _steps(blobs: list[bytes]):
    """Covered positions of runs with bytes, some whole buckets at a time."""
    records, texts = [np.empty(0, RECORD)], []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        records.append(_unpack([blob[8 : 8 + n * RECORD.itemsize]]))
        texts.append(np.frombuffer(blob, np.uint8, offset=8 + n * RECORD.itemsize))
    records = np.concatenate(records)
    if not len(records):
        return
    data = np.concatenate(texts)
    size = (records["n"] & _COUNT).astype(np.int64) + LENGTH - 1
    begin = np.cumsum(size) - size
    order = np.argsort(records["m"], kind="stable")
    records, size, begin = records[order], size[order], begin[order]
    edges = np.r_[np.flatnonzero(np.r_[True, records["m"][1:] != records["m"][:-1]]), len(records)]
    weight = np.r_[0, np.cumsum(size)][edges]
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(weight, weight[at] + STEP_BYTES, "right")) - 1)
        s, e = edges[at], edges[to]
        if e - s > 1:
            yield refine_buckets(records[s:e], data[_expand(begin[s:e], size[s:e])])
        at = to


def suffix_order(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of all positions: positions that differ within ``depth`` bytes are in lexical order of their suffixes.

    ``ends`` says for each position where its text ends; a suffix that ends sorts first.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(GRAM, np.uint8)]
    gram = np.zeros(n, np.uint64)
    where = np.arange(n)
    for j in range(GRAM):
        gram = gram << ts.U64(8) | padded[j : j + n] * (where + j < ends)
    order = np.argsort(gram)
    new = np.r_[True, gram[order[1:]] != gram[order[:-1]]]
    pointer = np.empty(n, np.int64)
    pointer[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    offset, active = GRAM, np.arange(n)  # active: places in the order whose buckets may hold several
    while offset < depth:
        bucket = pointer[order[active]]
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        active = active[~(new & np.r_[new[1:], True])]
        bucket = pointer[order[active]]
        # buckets one after the other, in a few shares: each reads the pointers that those before it have left
        cuts = np.unique(np.searchsorted(bucket, np.linspace(0, n, 5).astype(np.int64)))
        for s, e in zip(cuts, cuts[1:]):
            own = order[active[s:e]]
            later = own + offset
            key = bucket[s:e] * (n + 1) + np.where(later < ends[own], pointer[np.minimum(later, n - 1)] + 1, 0)
            by = np.argsort(key)
            own, key, here = own[by], key[by], bucket[s:e]
            first, split = np.r_[True, here[1:] != here[:-1]], np.r_[True, key[1:] != key[:-1]]
            order[active[s:e]] = own
            pointer[own] = here + np.flatnonzero(split)[np.cumsum(split) - 1] - np.flatnonzero(first)[np.cumsum(first) - 1]
        offset *= 2
    return pointer


def refine_buckets(records: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Covered positions, as records of one, among runs whose bytes are ``data`` one after the other."""
    count = (records["n"] & _COUNT).astype(np.int64)
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    pointer = suffix_order(data, np.repeat(begin + size, size), LENGTH)
    run = np.repeat(np.arange(len(records)), count)
    at = _expand(begin, count)
    found = np.empty(len(at), RECORD)
    found["m"], found["h"], found["n"] = 0, 0, 1
    found["doc"], found["own"], found["start"] = records["doc"][run], records["own"][run], records["start"][run] + (at - begin[run])
    order = np.argsort(pointer[at], kind="stable")
    new = np.ones(len(order), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for s in range(0, len(order) - 1, 1 << 16):  # neighbours, byte by byte
        e = min(s + (1 << 16), len(order) - 1)
        near = s + np.flatnonzero(data[at[order[s:e]]] == data[at[order[s + 1 : e + 1]]])
        new[near + 1] = (windows[at[order[near]]] != windows[at[order[near + 1]]]).any(axis=1)
    found["h"][order] = np.cumsum(new)
    found = found[np.lexsort((found["start"], found["own"], found["doc"], found["h"]))]
    return found[np.r_[False, found["h"][1:] == found["h"][:-1]]]


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _names(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the LENGTH-byte strings at some positions: of 25 bytes, then pairs of them, twice; and of the whole."""
    sums = ts.prefix(data)
    step = LENGTH // 4
    names = [ts.span_hash(sums, at + j * step, at + (j + 1) * step) for j in range(4)]
    while len(names) > 1:
        names = [ts.mix(a * _DEEPER + b) for a, b in zip(names[::2], names[1::2])]
    return names[0], ts.span_hash(sums, at, at + LENGTH)


def _bundle(batches):
    """The rows of each part and batch, equal ones once, as one compressed Arrow stream, which takes far less room in a shuffle."""
    for batch in sliced(batches, "text", 8 << 20):
        part, doc, own = (batch.column(c).to_numpy() for c in ("part", "doc", "own"))
        order = np.lexsort((own, doc, part))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
        times = np.diff(np.r_[np.flatnonzero(new), len(order)])
        order = order[new]
        part = part[order]
        rows = batch.select(["doc", "own", "doc_id", "text"]).take(pa.array(order)).append_column("times", pa.array(times, pa.int64()))
        cuts = np.flatnonzero(np.diff(part)) + 1
        out = []
        for s, e in zip([0, *cuts], [*cuts, len(part)]) if len(part) else ():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(rows.slice(s, e - s))
            out.append((int(part[s]), sink.getvalue().to_pybytes()))
        yield _batch(out)


_BUNDLED = pa.schema([("doc", pa.int64()), ("own", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("times", pa.int64())])


def _unbundle(table: pa.Table) -> pa.Table:
    each = [pa.ipc.open_stream(b).read_all() for b in table.column("blob").to_pylist()]
    return pa.concat_tables(each) if each else _BUNDLED.empty_table()


def _by_document(records: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    records = records[np.lexsort((records["own"], records["doc"]))]
    cuts = np.flatnonzero((np.diff(records["doc"]) != 0) | (records["own"][1:] != records["own"][:-1])) + 1
    return {(int(g["doc"][0]), int(g["own"][0])): g for g in np.split(records, cuts) if len(g)}


def _keys(texts: pa.Table):
    return zip(texts.column("doc").to_pylist(), texts.column("own").to_pylist())


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, array of start and end) and kept (the remaining bytes)."""
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    shared_dir(df.sparkSession)
    n = parts(docs, 4 << 20)
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NONE)).alias("doc"), F.xxhash64("text").alias("own"), "text")

    def scan(batches):
        for batch in sliced(batches, "text", 8 << 20):
            data, offsets = ts.utf8(batch.column("text"))
            records, bucket = _scan_rows(data, offsets, batch.column("doc").to_numpy(), batch.column("own").to_numpy())
            yield _batch(list(_route(records, bucket, n)))

    runs = docs.select("doc", "own", "text").mapInArrow(scan, "part int, blob binary")
    ranges = stage(_ranges(runs, n, True), "runs")
    placed = docs.select(_place_column(F.col("doc"), F.col("own"), n).alias("part"), "doc", "own", "doc_id", "text").mapInArrow(_bundle, "part int, blob binary")

    def look(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        texts = _unbundle(texts)
        by_doc = _by_document(_unpack(wanted.column("blob").to_pylist()))
        data, offsets = ts.utf8(texts.column("text"))
        hot, runs, pieces = [np.empty(0, RECORD)], [np.empty(0, RECORD)], []
        for i, key in enumerate(_keys(texts)):
            own = by_doc.pop(key, None)
            if own is None:
                continue
            body = data[offsets[i] : offsets[i + 1]]
            flagged = (own["n"] & _FLAG) > 0
            at = np.unique(_expand(own["start"][flagged].astype(np.int64), (own["n"][flagged] & _COUNT).astype(np.int64)))
            found = np.empty(len(at), RECORD)
            found["h"], whole = _names(body, at)
            found["m"], found["doc"], found["own"], found["start"], found["n"] = whole.astype(np.uint32), *key, at, 1
            hot.append(found)
            own = own[~flagged]
            runs.append(own)
            pieces += [body[s : s + c + LENGTH - 1].tobytes() for s, c in zip(own["start"].tolist(), own["n"].tolist())]
        hot, runs = np.concatenate(hot), np.concatenate(runs)
        rows = list(_route(hot, hot["h"], n))
        rows += _with_bytes(runs, pieces, 2 * n + (ts.mix(runs["m"].astype(np.uint64)) % ts.U64(n)).astype(np.int64))
        return pa.Table.from_batches([_batch(rows)])

    wanted = ranges.where("kind = 2").select("part", "blob")
    strings = placed.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(look, "part int, blob binary")
    covered = ranges.where("kind = 1").select("part", "blob").union(_ranges(strings, n, False).where("kind = 1").select("part", "blob"))

    def cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
        texts = _unbundle(texts)
        by_doc = _by_document(_unpack(marks.column("blob").to_pylist()))
        data, offsets = ts.utf8(texts.column("text"))
        spans, kept = [], []
        for i, key in enumerate(_keys(texts)):
            body, own = data[offsets[i] : offsets[i + 1]], by_doc.get(key)
            if own is None:
                spans.append([])
                kept.append(body.tobytes())
                continue
            edge = np.zeros(len(body) + 2, np.int32)
            start = own["start"].astype(np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + (own["n"] & _COUNT) - 1 + LENGTH, -1)
            gone = np.cumsum(edge[: len(body) + 1]) > 0
            gone[-1] = False
            turn = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)))
            spans.append([{"start": s, "end": e} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist())])
            kept.append(body[~gone[:-1]].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": texts.column("doc_id"), "times": texts.column("times"), "n_bytes": pa.array(np.diff(offsets)), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    found = placed.groupBy("part").cogroup(covered.groupBy("part")).applyInArrow(cut, "doc_id long, times long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "n_bytes", "spans", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

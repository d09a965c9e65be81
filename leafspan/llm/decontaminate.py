"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are lower-cased (A-Z) with runs of white space as one blank.  An
item longer than WHOLE characters is cut into pieces of PIECE characters, STEP apart,
so a leak of a part is found too, if it holds PIECE + STEP - 1 characters.  A piece of m characters may differ by
``k = floor(RATE * m)`` edits.  By the q-gram lemma, text within k edits of a piece
shares at least ``m - Q + 1 - k * Q`` character q-grams with it, on neighbouring
diagonals (text position less piece position).  Shared q-grams are counted in bands
of diagonals that overlap by the largest k; only bands that reach the bound are kept,
and each is verified by a banded alignment, all of a block at once.

Every text is scanned whole, where it lies: no shuffle.  A long text is taken in
stretches of STRETCH characters that overlap by more than a region, and pairs of equal
q-grams at most PAIRS at a time (or those of one place), as bands behind the last place
are finished.  So memory follows neither a text's length nor how often it repeats
itself.  The items' q-gram index is broadcast; its size is bounded, as items are taken
in groups of about ITEM_BYTES bytes, one scan for each group.

Defined cases: null text holds nothing; null items, and those of fewer than ``least``
characters (Q at least), are no evidence and are never reported; equal items are
reported each; of several places in a text the one with the fewest edits, then the
first, is reported; rows with equal or null doc_id are judged each on its own; other
columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import shared_dir, sliced
from .langid import code_points

Q, RATE = 8, 0.1
WHOLE, PIECE, STEP = 120, 100, 25
#: Characters under which an item is no evidence.
LEAST = 2 * Q
#: Bytes of items indexed at once; about 60 bytes of index for each.
ITEM_BYTES = 4 << 20
#: Characters of a text, and pairs of equal q-grams, looked at together.
STRETCH, PAIRS = 1 << 20, 1 << 20
_BAND = 32
_MOST = int(RATE * WHOLE)
_GAP = 2 * (WHOLE + _BAND)
_BITS = 22


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with one blank for each run of white space, offsets of rows, and the place of each byte in ``data``."""
    space = ts.SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(keep):
        keep[offsets[:-1][offsets[:-1] < len(keep)]] = True
    at = np.flatnonzero(keep)
    out = ts.LOWER[data[at]]
    out[space[at]] = 32
    return out, np.searchsorted(at, offsets), at


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-grams that start at each character (0 where a row ends before), and the characters' places."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) < Q:
        return np.zeros(len(lead), np.uint64), lead
    ends = np.r_[lead, len(data)]
    hashes = np.zeros(len(lead), np.uint64)
    hashes[: len(lead) - Q + 1] = ts.span_hash(ts.prefix(data), lead[: len(lead) - Q + 1], ends[Q:])
    rows = np.searchsorted(lead, offsets)
    for j in range(1, Q):
        at = rows[1:] - j
        hashes[at[at >= rows[:-1]]] = 0
    return hashes, lead


class Index:
    """Pieces of items and where their q-grams stand."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        texts = pa.array([text for _, text in items], pa.string())
        data, offsets, _ = normalise(*ts.utf8(texts))
        points, rows = code_points(data, offsets)
        self.item, self.points, starts = [], [], []
        for i, (item, _) in enumerate(items):
            own = points[rows[i] : rows[i + 1]]
            own = own[int(own[0] == 32) : len(own) - int(own[-1] == 32)] if len(own) else own
            if len(own) < max(Q, least):
                continue
            cuts = [0] if len(own) <= WHOLE else sorted({*range(0, len(own) - PIECE, STEP), len(own) - PIECE})
            for cut in cuts:
                self.item.append(item)
                self.points.append(own[cut : cut + (PIECE if len(own) > WHOLE else len(own))].astype(np.int32))
                starts.append(cut)
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.budget = np.minimum((RATE * self.size).astype(np.int64), (self.size - Q) // Q)
        self.bound = np.maximum(self.size - Q + 1 - self.budget * Q, 1)
        text = "".join(map(chr, np.concatenate([np.zeros(0, np.int32), *self.points]).tolist()))
        ends = np.cumsum(self.size)
        pieces = pa.array([text[e - s : e] for s, e in zip(self.size, ends)], pa.string())
        raw, offsets = ts.utf8(pieces)
        hashes, _ = _grams(raw, offsets)
        piece = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(piece)) - np.repeat(ends - self.size, self.size)
        there = hashes != 0
        order = np.argsort(hashes[there], kind="stable")
        self.grams, first, count = np.unique(hashes[there][order], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        self.piece, self.place = piece[there][order].astype(np.int32), place[there][order].astype(np.int16)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.grams >> ts.U64(64 - _BITS)).astype(np.int64)] = True


def _bands(index: Index, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, band) whose shared q-grams reach the bound; bands count diagonals that are spaced out by row."""
    at = np.flatnonzero(index.maybe[(hashes >> ts.U64(64 - _BITS)).astype(np.int64)])
    where = np.minimum(np.searchsorted(index.grams, hashes[at]), len(index.grams) - 1)
    real = index.grams[where] == hashes[at]
    at, where = at[real], where[real]
    entries = index.count[where].astype(np.int64)
    sums = np.r_[0, np.cumsum(entries)]
    spaced = at + row[at] * _GAP
    open_key, open_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, s = [np.zeros(0, np.int64)], 0
    while s < len(at):
        e = max(s + 1, int(np.searchsorted(sums, sums[s] + PAIRS, "right")) - 1)
        n = entries[s:e]
        entry = np.repeat(index.first[where[s:e]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        diagonal = np.repeat(spaced[s:e], n) - index.place[entry] + WHOLE
        piece, band, inside = index.piece[entry].astype(np.int64), diagonal // _BAND, diagonal % _BAND
        both = inside < _MOST
        key, n = np.unique(np.concatenate([piece << 40 | band, piece[both] << 40 | (band[both] - 1)]), return_counts=True)
        if len(open_key):
            key, which = np.unique(np.concatenate([open_key, key]), return_inverse=True)
            n = np.bincount(which, np.concatenate([open_n, n]), len(key)).astype(np.int64)
        # a band that ends before the diagonals of the next place gets no more
        later = spaced[e] if e < len(at) else 1 << 62
        band = key & ((1 << 40) - 1)
        done = (band + 1) * _BAND + _MOST <= later
        out.append(key[done & (n >= index.bound[key >> 40])])
        open_key, open_n = key[~done], n[~done]
        s = e
    key = np.sort(np.concatenate(out))
    return key >> 40, key & ((1 << 40) - 1)


def _align(index: Index, piece: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits of each piece inside its region, and where that place starts and ends.

    Cell x of line p aligns the piece's first p + 1 characters with text up to
    region place p + x; the text's ends are free.
    """
    size = index.size[piece]
    width, longest = _BAND + 3 * _MOST, int(size.max())
    points = np.full((len(piece), longest), -2, np.int32)
    for i, p in enumerate(piece):
        points[i, : size[i]] = index.points[p]
    step, x = np.int32(1 << 12), np.arange(width, dtype=np.int32)
    now = np.tile(x, (len(piece), 1)).astype(np.int32)
    best = np.full(len(piece), 1 << 40, np.int64)
    end = np.zeros(len(piece), np.int64)
    for p in range(longest):
        value = now + step * (region[:, p : p + width] != points[:, p : p + 1])
        value[:, :-1] = np.minimum(value[:, :-1], now[:, 1:] + step)
        now = np.minimum.accumulate(value - x * step, axis=1) + x * step
        last = np.flatnonzero(size == p + 1)
        if len(last):
            cell = np.argmin(now[last], axis=1)
            best[last], end[last] = now[last, cell], p + cell + 1
    return best // step, best % step, end


def _places(index: Index, text: np.ndarray, rows: np.ndarray):
    """(row, piece, first, end, edits): places of pieces in normal texts, by the number of the character in ``text``."""
    hashes, lead = _grams(text, rows)
    if not len(hashes) or not len(index.grams):
        return
    starts = np.searchsorted(lead, rows)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(starts))
    pieces, bands = _bands(index, hashes, row)
    if not len(pieces):
        return
    points, _ = code_points(text, rows)
    width = _BAND + 3 * _MOST + WHOLE
    # spaced positions of the rows' first characters tell the row of a band
    spaced = starts[:-1] + np.arange(len(rows) - 1) * _GAP
    for s in range(0, len(pieces), 256):
        piece, first = pieces[s : s + 256], bands[s : s + 256] * _BAND - WHOLE - _MOST
        # a place past the first shared q-gram of the band and short of the next row
        own = np.searchsorted(spaced, first + 2 * _MOST + _BAND + index.size[piece], "right") - 1
        first = first - own * _GAP
        place = first[:, None] + np.arange(width)
        inside = (place >= starts[own][:, None]) & (place < starts[own + 1][:, None])
        region = np.where(inside, points[np.clip(place, 0, len(points) - 1)], -1)
        edits, begin, end = _align(index, piece, region)
        for i in np.flatnonzero(edits <= index.budget[piece]).tolist():
            yield int(own[i]), int(piece[i]), max(int(first[i] + begin[i]), int(starts[own[i]])), min(int(first[i] + end[i]), int(starts[own[i] + 1])), int(edits[i])


def _search(index: Index, batch: pa.RecordBatch):
    """(row, item, start, end, edits, size): the best place of each item in each row of one batch."""
    data, offsets = ts.utf8(batch.column("text"))
    found: dict[tuple[int, int], tuple] = {}
    for at, to in ts.blocks(offsets):
        raw, rows = ts.bytes_slice(data, offsets, at, to)
        text, rows, origin = normalise(raw, rows)
        lead = np.flatnonzero((text & 0xC0) != 0x80)
        characters = None
        overlap = 2 * _GAP
        for c in range(0, max(1, len(lead) - overlap), STRETCH) if len(lead) > 2 * STRETCH and to - at == 1 else (0,):
            # one long row in stretches, else some whole rows
            cut = len(lead) <= 2 * STRETCH or to - at > 1
            piece_of = text if cut else text[lead[c] : lead[c + STRETCH + overlap] if c + STRETCH + overlap < len(lead) else len(text)]
            for row, piece, low, high, edits in _places(index, piece_of, rows if cut else np.array([0, len(piece_of)])):
                if characters is None:
                    characters = np.cumsum((raw & 0xC0) != 0x80) - 1
                    starts = np.searchsorted(lead, rows)
                base = characters[origin[lead[starts[row]]]]
                hit = (edits, int(characters[origin[lead[low + c]]] - base), int(characters[origin[lead[high + c - 1]]] - base) + 1, int(index.size[piece]))
                key = (at + row, index.item[piece])
                if key not in found or (hit[0] / hit[3], hit[1]) < (found[key][0] / found[key][3], found[key][1]):
                    found[key] = hit
    return [(row, item, s, e, edits, size) for (row, item), (edits, s, e, size) in sorted(found.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_column: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """The key columns of each text that holds an item, with item_id, start, end (characters), edits and piece_chars."""
    spark = docs.sparkSession
    shared_dir(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("body")).where("item is not null and body is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    groups = max(1, -(-size // ITEM_BYTES))
    rows = docs.select(*keys, F.col(text_column).alias("text")).where(F.col("text").isNotNull())
    own = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys)
    out = None
    for group in range(groups):
        part = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(groups)) == group) if groups > 1 else items
        index = spark.sparkContext.broadcast(Index([(r.item, r.body) for r in part.orderBy("item", "body").collect()], least))

        def search(batches, index=index):
            for batch in sliced(batches, "text", 8 << 20):
                hits = _search(index.value, batch)
                if hits:
                    at = pa.array([h[0] for h in hits])
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array([h[j] for h in hits], pa.int64()) for j in range(1, 6))], [*keys, "item_id", "start", "end", "edits", "piece_chars"])

        found = rows.mapInArrow(search, f"{own}, item_id long, start long, end long, edits long, piece_chars long")
        out = found if out is None else out.union(found)
    return out


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

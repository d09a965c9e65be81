"""Language identification by rank-order profiles of character n-grams.

``train`` counts letters, pairs and triples of letters (words padded by blanks,
case folded) of every labelled text and keeps the PROFILE most frequent of each
language with their ranks.  An n-gram's code holds the code points of its letters,
21 bits each, so all scripts count alike and no two n-grams share a code.  ``predict`` ranks the n-grams of a whole text likewise
and sums the places by which each is out of its place in a profile; an n-gram
missing there counts PROFILE places.  The nearest profile wins, ties go to the
first in alphabetical order; the score is 1 less the distance as a share of the
largest possible.  Counts are over all labelled rows; only the profiles, PROFILE
rows for each label, reach the driver and are broadcast, 20 bytes a row; more than
LABELS labels are an error.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is
every text if no label was learned; null labels teach nothing; a null doc_id is
never held out and teaches nothing; marks (vowel signs, accents of their own) count
as letters of a word, but a text of marks alone has no letter; other columns are not
read.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts

#: N-grams in a profile.
PROFILE = 300
#: Labels whose profiles may be broadcast.
LABELS = 50_000
#: Distinct n-grams that a task holds before it passes their counts on.
HELD = 1 << 21
#: What stands for the blank around words: above all code points.
BLANK = 0x110000


@functools.cache
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its small letter (0 for what is neither letter nor mark), and whether it is a letter."""
    table, letter = np.zeros(0x110000, np.int32), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            table[cp], letter[cp] = ord(chr(cp).lower()[0]), kind == "L"
    return table, letter


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets of rows among them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at]
    out = first.astype(np.int32)
    for low, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        which = np.flatnonzero((first >= low) & (first < (low | (low >> 1) & 0x70 | 0x10 if more == 2 else low + (0x20 if more == 1 else 0x10))))
        if len(which):
            value = (first[which] & keep).astype(np.int32)
            for j in range(1, more + 1):
                value = value << 6 | (data[at[which] + j] & 0x3F)
            out[which] = value
    return out, np.searchsorted(at, offsets)


def _symbol_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each row, with one blank for each run of other characters and at both ends; offsets of rows.

    Rows without a letter have blanks alone.
    """
    points, rows = code_points(data, offsets)
    table, letter = _symbols()
    symbols = table[points]
    letters = np.r_[0, np.cumsum(letter[points])]
    bare = letters[rows[1:]] == letters[rows[:-1]]
    if bare.any():
        symbols[np.repeat(bare, np.diff(rows))] = 0
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    if len(keep):
        firsts = rows[:-1][rows[:-1] < rows[1:]]
        keep[firsts] = symbols[firsts] > 0
    lengths = np.diff(np.r_[0, np.cumsum(keep)][rows])
    starts = np.cumsum(lengths + 2) - lengths - 2
    out = np.zeros(int((lengths + 2).sum()), np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(row)) + 2 * row + 1] = symbols[keep]
    return out, np.r_[starts, len(out)]


def _counts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of runs of symbols and how often each occurs.

    Symbols are numbered by a small alphabet first, so that a long run is counted in
    a table; codes then hold the code points.
    """
    seen = np.zeros(BLANK, bool)
    seen[s] = True
    alphabet = np.flatnonzero(seen)
    alphabet = np.r_[0, alphabet[alphabet > 0]]
    number = np.zeros(BLANK, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    d, n = number[s], len(alphabet)
    pairs = d[:-1] * n + d[1:]
    triples = (pairs[:-1] * n + d[2:])[d[1:-1] > 0]
    codes = np.concatenate([d[d > 0], pairs[pairs > 0] + n, triples + n + n * n])
    size = n + n * n + n**3
    if len(codes) * 4 > size:
        counts = np.bincount(codes, minlength=size)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(codes, return_counts=True)
    points = np.where(alphabet > 0, alphabet, BLANK)
    one, two = found < n, (found >= n) & (found < n + n * n)
    pair, triple = found[two] - n, found[~one & ~two] - n - n * n
    return np.concatenate([points[found[one]], points[pair // n] << 21 | points[pair % n], points[triple // (n * n)] << 42 | points[triple // n % n] << 21 | points[triple % n]]), counts


def _top(symbols: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent codes, first the most frequent, ties by code."""
    codes, counts = _counts(symbols)
    if len(codes) > PROFILE:
        least = -np.partition(-counts, PROFILE - 1)[PROFILE - 1]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:PROFILE]


def train(df: DataFrame, text_column: str = "text", label_column: str = "lang") -> list[tuple[str, int, int]]:
    """(label, n-gram code, rank) of the profiles, from every row that has both text and label."""
    rows = df.select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang):
            codes, counts = (np.concatenate(c) for c in zip(*held[lang]))
            codes, where = np.unique(codes, return_inverse=True)
            return codes, np.bincount(where, counts, len(codes)).astype(np.int64)

        def flush():
            for lang in held:
                codes, counts = merged(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            data, offsets = ts.utf8(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, to in ts.blocks(offsets):
                symbols, runs = _symbol_runs(*ts.bytes_slice(data, offsets, at, to))
                for lang in sorted(set(langs[at:to])):
                    own = np.repeat(langs[at:to] == lang, np.diff(runs))
                    held.setdefault(lang, []).append(_counts(symbols[own]))
                    if len(held[lang]) >= 16:
                        held[lang] = [merged(lang)]
                if sum(len(c) for each in held.values() for c, _ in each) > HELD:
                    yield from flush()
        yield from flush()

    counted = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    found = [tuple(r) for r in counted.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "code", "rank").limit(LABELS * PROFILE + 1).collect()]
    if len(found) > LABELS * PROFILE:
        raise ValueError(f"more than {LABELS} labels")
    return found


def predict(df: DataFrame, profiles: list[tuple[str, int, int]], text_column: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns, lang_pred, score (0 to 1) and margin (the second's distance less the first's, as a share)."""
    langs = sorted({p[0] for p in profiles})
    number = {lang: i for i, lang in enumerate(langs)}
    # places by code: of each code a run of (label, rank)
    places = np.array(sorted((code, number[lang], rank - 1) for lang, code, rank in profiles), np.int64).reshape(-1, 3)
    codes, first = np.unique(places[:, 0], return_index=True)
    shared = df.sparkSession.sparkContext.broadcast((codes, np.r_[first, len(places)], places[:, 1].astype(np.int32), places[:, 2].astype(np.int32)))
    # a text among the keys is not sent twice
    text = text_column if text_column in keys else "_text"
    df = df.select(*keys) if text_column in keys else df.select(*keys, F.col(text_column).alias("_text"))

    def one(symbols: np.ndarray, table: tuple[np.ndarray, ...]) -> tuple[str, float, float]:
        if not len(langs) or not symbols.any():
            return "und", 0.0, 0.0
        codes, first, label, rank = table
        top = _top(symbols)
        where = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
        known = np.flatnonzero(codes[where] == top)
        begin, n = first[where[known]], first[where[known] + 1] - first[where[known]]
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        most = PROFILE * len(top)
        # a code that a profile has is as far as its ranks differ, any other PROFILE places
        away = most + np.bincount(label[entry], np.abs(rank[entry] - np.repeat(known, n)) - PROFILE, len(langs)).astype(np.int64)
        best = int(np.argmin(away))
        others = np.delete(away, best)
        return langs[best], 1 - float(away[best]) / most, float(others.min() - away[best]) / most if len(others) else 1.0

    def guess(batches):
        table = shared.value
        for batch in batches:
            data, offsets = ts.utf8(batch.column(text))
            out = []
            for at, to in ts.blocks(offsets):
                symbols, runs = _symbol_runs(*ts.bytes_slice(data, offsets, at, to))
                out += [one(symbols[s:e], table) for s, e in zip(runs[:-1], runs[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.float64())], [*keys, "lang_pred", "score", "margin"])

    own = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k in keys)
    return df.mapInArrow(guess, f"{own}, lang_pred string, score double, margin double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document belongs to the quarter that teaches nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(documents: DataFrame) -> list[tuple[str, int, int]]:
    """Profiles from the documents that are not held out."""
    return train(documents.where(F.col("doc_id").isNotNull() & ~held_out()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, learned(documents), keys=("doc_id", "held_out"))

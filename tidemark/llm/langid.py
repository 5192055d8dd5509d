"""Language identification (operator 10) by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters, words padded by a blank) of all training text of one
language, in order. A document's own list is compared to each profile by out-of-place distance: the sum, over its
n-grams, of the difference of ranks, or of the profile's length where the profile lacks the n-gram. The nearest profile
wins; the score is one less the distance as a part of the largest possible one.

Counts cover all training rows: each task adds up its own texts, and a shuffle adds up the tasks. Only the profiles, at
most MAX_LANGUAGES x PROFILE_SIZE n-grams of some 16 bytes, come to the driver and are broadcast; more languages are refused, none is dropped.
A long text is counted in windows of WINDOW characters, so its memory is bounded beside the text itself.

Defined cases: texts of any length are read whole; text that is null, empty or without a letter gives `und` with score 0; so does any text if nothing could be
learned; training rows without lang or text teach nothing; equal counts rank by code point; equal distances go to the
smaller language name; repeated rows count as often as they occur; a column named lang_pred or score is replaced, others
may have any name and type; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField
from pyspark.sql.window import Window

from .common import cut, lean, named, replacing, table, with_arrays

#: N-grams in a language's profile and in a document's list.
PROFILE_SIZE = 400
DOCUMENT_SIZE = 300
#: Languages that can be learned; bounds the broadcast.
MAX_LANGUAGES = 10_000
#: Characters that are counted at a time.
WINDOW = 1_000_000
UNKNOWN = "und"
BLANK, STEP = 32, 21  # a blank's code point; bits for a code point
#: Rows that a worker takes up at a time.
ROWS = 500


@cache
def _letters() -> np.ndarray:
    """By code point: itself if a letter, else a blank."""
    known = np.full(0x110000, BLANK, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            known[c] = c
    return known


class Grams:
    """All n-grams of a list of texts: small codes for counting, and the way back to global ones."""

    def __init__(self, texts: list[str]):
        texts = [t.lower() for t in texts]
        points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        points = _letters()[points]
        ends = np.cumsum([0] + [len(t) + 1 for t in texts])  # positions of the blanks between texts
        blank = points == BLANK
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[0] = True
        self.bounds = (np.cumsum(keep) - 1)[ends]  # the blank, or the one it fell together with, before each text
        points = points[keep]
        seen = np.zeros(0x110000, dtype=bool)
        seen[points] = True
        seen[BLANK] = True
        self.points = np.flatnonzero(seen).astype(np.int64)
        size = self.size = len(self.points)
        number = np.zeros(0x110000, dtype=np.int64)
        number[self.points] = np.arange(size)
        c = number[points]
        self.blank = number[BLANK]
        self.c, void = c, -1
        letter = c != self.blank
        one = np.where(letter, c, void)
        two = np.full(len(c), void, dtype=np.int64)
        three = np.full(len(c), void, dtype=np.int64)
        two[:-1] = np.where(letter[:-1] | letter[1:], size + c[:-1] * size + c[1:], void)
        three[:-2] = np.where(letter[1:-1], size + size * size + (c[:-2] * size + c[1:-1]) * size + c[2:], void)
        self.codes = np.stack([one, two, three])

    def of(self, k: int) -> np.ndarray:
        """Codes of the k-th text's n-grams."""
        low, high = int(self.bounds[k]), int(self.bounds[k + 1])
        if high <= low:
            return np.empty(0, dtype=np.int64)
        found = np.concatenate([self.codes[0, low + 1 : high], self.codes[1, low:high], self.codes[2, low : high - 1]])
        return found[found >= 0]

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Codes that mean the same for any list of texts: the code points, STEP bits each."""
        size, points = self.size, self.points
        out = np.empty(len(codes), dtype=np.int64)
        one, three = codes < size, codes >= size + size * size
        two = ~one & ~three
        out[one] = points[codes[one]]
        a = codes[two] - size
        out[two] = (points[a // size] << STEP) | points[a % size]
        a = codes[three] - size - size * size
        out[three] = (points[a // (size * size)] << 2 * STEP) | (points[a // size % size] << STEP) | points[a % size]
        return out


def _counted(codes: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(codes, return_counts=True)
    return grams.packed(found), counts


def counted_in_windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, packed, and their counts) of one text of any length."""
    text, carry = text.lower(), np.array([BLANK], dtype=np.int64)
    found, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for at in range(0, max(len(text), 1), WINDOW):
        last = at + WINDOW >= len(text)
        points = _letters()[np.frombuffer(text[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int64)
        points = np.concatenate([carry, points, [BLANK, BLANK, BLANK] if last else []]).astype(np.int64)
        keep = points != BLANK
        keep[1:] |= keep[:-1]
        keep[0] = True
        if last:  # two blanks at the end, so that every start has its n-grams
            points = np.concatenate([points[keep], [BLANK, BLANK]])
        else:
            points = points[keep]
        if len(points) < 3:
            carry = points
            continue
        a, b, c = points[:-2], points[1:-1], points[2:]
        x, y = a != BLANK, b != BLANK
        grams = np.concatenate([a[x], ((a << STEP) | b)[x | y], ((a << 2 * STEP) | (b << STEP) | c)[y]])
        new, n = np.unique(grams, return_counts=True)
        found, back = np.unique(np.concatenate([found, new]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(found)).astype(np.int64)
        carry = points[-2:]
    return found, counts


def top(found: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    if len(found) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.lexsort((found, -counts))[:size]]


def ranked(codes: np.ndarray, grams: Grams, size: int) -> np.ndarray:
    """The most frequent n-grams, packed, most frequent first."""
    found, counts = np.unique(codes, return_counts=True)
    if len(found) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        found, counts = found[counts >= least], counts[counts >= least]
    return top(grams.packed(found), counts, size)


class Profiles:
    """languages, and for each n-gram of any profile the languages that have it, with its rank."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE_SIZE):
        self.size = size
        self.languages = sorted({r[0] for r in rows})
        at = {name: k for k, name in enumerate(self.languages)}
        rows = sorted((gram, at[name], rank) for name, gram, rank in rows)
        self.grams, self.begin = np.unique(np.array([r[0] for r in rows], dtype=np.int64), return_index=True)
        self.begin = np.append(self.begin, len(rows)).astype(np.int64)
        self.language = np.array([r[1] for r in rows], dtype=np.int32)
        self.rank = np.array([r[2] for r in rows], dtype=np.int32)

    def nearest(self, listed: np.ndarray) -> tuple[str, float]:
        if not len(listed) or not self.languages:
            return UNKNOWN, 0.0
        where = np.minimum(np.searchsorted(self.grams, listed), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[where] == listed)
        begin, many = self.begin[where[place]], self.begin[where[place] + 1] - self.begin[where[place]]
        entry = np.repeat(begin - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        # What a known n-gram is nearer than one that the profile lacks.
        nearer = self.size - np.abs(self.rank[entry] - np.repeat(place, many))
        apart = self.size * len(listed) - np.bincount(self.language[entry], weights=nearer, minlength=len(self.languages))
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (self.size * len(listed)))


def _blocks(texts: list[str | None], most: int = WINDOW) -> Iterator[list[str]]:
    """Lists of texts of bounded total length (a longer text is alone)."""
    held, length = [], 0
    for t in texts:
        if held and length + len(t or "") > most:
            yield held
            held, length = [], 0
        held.append(t or "")
        length += len(t or "")
    if held:
        yield held


def _all(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, packed, and their counts) of a block of texts together."""
    if len(block) == 1 and len(block[0]) > WINDOW:
        return counted_in_windows(block[0])
    grams = Grams(block)
    codes = grams.codes[grams.codes >= 0]
    if grams.size**3 < 1 << 24:
        counts = np.bincount(codes)
        found = np.flatnonzero(counts)
        return grams.packed(found), counts[found]
    return _counted(codes, grams)


def _each(block: list[str], size: int) -> Iterator[np.ndarray]:
    """The most frequent n-grams of each text of a block."""
    if len(block) == 1 and len(block[0]) > WINDOW:
        yield top(*counted_in_windows(block[0]), size)
        return
    grams = Grams(block)
    for k in range(len(block)):
        yield ranked(grams.of(k), grams, size)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from all rows of docs that have a language and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[int, int]] = {}
        for batch in _slices(batches):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                mine = totals.setdefault(name, {})
                for block in _blocks([t for n, t in zip(names, texts, strict=True) if n == name]):
                    for g, n in zip(*(x.tolist() for x in _all(block)), strict=True):
                        mine[g] = mine.get(g, 0) + n
            if sum(map(len, totals.values())) > 500_000:
                yield from rows(totals)
                totals = {}
        yield from rows(totals)

    def rows(totals: dict[str, dict[int, int]]) -> Iterator[pa.RecordBatch]:
        for name, counts in totals.items():
            gram, n = pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts), pa.string()), gram, n], names=["lang", "gram", "n"])

    labelled = docs.where(named(lang_col).isNotNull() & named(text_col).isNotNull())
    labelled = labelled.select(named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text"))
    counts = labelled.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(F.desc("n"), "gram")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= size).drop("r")
    best = cut(best.withColumn("rank", F.row_number().over(whole) - 1).where(F.col("rank") < size))
    languages = best.select("lang").distinct().count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages, more than {MAX_LANGUAGES}")
    rows = best.select("lang", "gram", "rank").toArrow()
    return Profiles(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)), size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", size: int = DOCUMENT_SIZE) -> DataFrame:
    """docs with lang_pred and score, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = replacing(docs, "lang_pred", "score")
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in _slices(batches):
            found = []
            for block in _blocks(batch.column(where).to_pylist()):
                found += [shared.value.nearest(listed) for listed in _each(block, size)]
            yield batch, [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return with_arrays(docs, run, [StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from; those without an id are learned from."""
    return F.coalesce(F.crc32(named(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose language could be told; those without a letter go."""
    found = identify(docs, learn(docs.where(~held_out(id_col))))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*[named(c) for c in docs.columns])


# ---------------------------------------------------------------- query
def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()).select("lang", "text"))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

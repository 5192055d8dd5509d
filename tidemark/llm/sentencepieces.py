"""SentencePiece encoding and decoding (operator 8) for merge-type vocabularies.

A text becomes a row of single characters, blanks written as U+2581 and one more in front. An agenda holds every adjacent
pair of symbols whose join is a piece, ordered by score, then by place from the left. The best pair is joined, pairs with
its new neighbours enter the agenda, pairs that lost a part are passed over. Characters left over that aren't pieces are
written as bytes. Decoding joins the pieces back and drops the first blank.

No piece has U+2581 behind another character and none holds a line end, which is checked when a vocabulary is loaded; so
symbols never join across such places, and a text is encoded chunk by chunk. Chunks recur, so each worker keeps a table of
the short ones, bounded by its bytes. Every chunk that is encoded is checked against the sentencepiece library, in one call for
all new chunks of some texts; a difference is an error, never a wrong row. A vocabulary without that property is
encoded text by text and checked text by text.

Defined cases: null and empty texts have no ids and decode to the empty text; a text may be of any length; U+2581 in a
text reads as a blank, as in the library; repeated rows are encoded each; columns named like an added one are replaced, others may have any
name and type; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField

from .common import named, replacing, table, with_arrays

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of chunks that a worker remembers, about; characters of the longest that is remembered; characters of new chunks that
#: are checked at once; rows that are handed on at a time.
REMEMBERED, LONGEST, CHECKED, ROWS = 96 << 20, 64, 1 << 20, 256
#: What a remembered chunk takes besides its characters and ids: two objects and a place in a table.
ENTRY = 150
#: Texts up to this length have their agenda as a list, longer ones as a heap.
SHORT, NEVER = 40, float("inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: list[int] = [p.unk_id()] * 256
        self.surface: list[bytes] = []
        for i in range(p.vocab_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            elif p.is_control(i):
                self.surface.append(b"")
            elif p.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.scores[piece] = i, -p.get_score(i)
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.chunked = not any(SPACE in x.lstrip(SPACE) or "\n" in x for x in self.ids)
        self.chunks = _Chunks(self)

    def agenda(self, text: str) -> list[int]:
        """Ids of a text that has its blanks and its first blank written as U+2581."""
        symbols = self._short(text) if len(text) <= SHORT else self._long(text)
        out, ids = [], self.ids
        for s in symbols:
            found = ids.get(s)
            if found is not None:
                out.append(found)
            else:
                out += [self.bytes[b] for b in s.encode()]
        return out

    def _short(self, text: str) -> list[str]:
        """The agenda as a list beside the symbols: entry i is the score of symbols i and i + 1, the first best wins."""
        symbols, score = list(text), self.scores.get
        agenda = [score(a + b, NEVER) for a, b in zip(text, text[1:])]  # noqa: B905
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbols[i] = joined = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(joined + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + joined, NEVER)
        return symbols

    def _long(self, text: str) -> list[str]:
        """The agenda as a heap of (score, place, join)."""
        symbols: list[str] = list(text)
        n, scores = len(symbols), self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(scores[s], i, s) for i in range(n - 1) if (s := symbols[i] + symbols[i + 1]) in scores]
        heapq.heapify(pairs)
        while pairs:
            _, i, joined = heapq.heappop(pairs)
            left, j = symbols[i], after[i]
            if not left or j >= n or left + symbols[j] != joined:
                continue  # a part of the pair has been joined to something else
            symbols[i], symbols[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := joined + symbols[k]) in scores:
                    heapq.heappush(pairs, (scores[s], i, s))
            if (h := before[i]) >= 0 and (s := symbols[h] + joined) in scores:
                heapq.heappush(pairs, (scores[s], h, s))
        return [s for s in symbols if s]

    def encode(self, text: str) -> list[int]:
        """Ids of a text. New chunks wait for check()."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.chunked:
            out = self.agenda(SPACE + text.replace(" ", SPACE))
            if out != self.library.encode(text):
                raise ValueError(f"the library encodes another way: {text[:200]!r}")
            return out
        parts = text.replace("\n", " \n").split(" ")  # a part that begins with a line end has no blank of its own
        if "" in parts:
            parts = _joined_blanks(parts)
        out = list(chain.from_iterable(map(self.chunks.__getitem__, parts)))
        if self.chunks.waiting > CHECKED:
            self.check()
        return out

    def check(self) -> None:
        """Hold the chunks that were encoded since the last call against the library."""
        new = self.chunks.taken()
        # The library puts a blank in front: the chunk's own, or one before the line end that is then passed over.
        for (key, mine), ids in zip(new.items(), self.library.encode(list(new), num_threads=1), strict=True):
            if (ids[1:] if key[0:1] == "\n" else ids) != mine.tolist():
                if key == "" and mine.tolist() == [self.ids[SPACE]]:
                    continue  # one blank alone: the library gives an empty text no ids
                raise ValueError(f"the library encodes another way: {key!r}")
        self.chunks.age()

    def decode(self, ids: list[int]) -> str:
        try:
            out = b"".join(map(self.surface.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # bytes that are no text: the library's way
            return self.library.decode(ids)
        return out[1:] if out[:1] == " " else out


class _Chunks(dict):
    """Ids by chunk. Keys are texts without the blank that stands in front, except those that begin with a line end.

    Once what is here takes half of REMEMBERED, it becomes the old half; a chunk found there is young again, the rest is
    forgotten when the next half is full. So frequent chunks stay. Long chunks, like lines of a script without blanks, wait for
    their check and are then forgotten.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.new, self.old = vocabulary, {}, {}
        self.bytes = self.waiting = 0

    def taken(self) -> dict[str, array]:
        """What waits for its check; long chunks go."""
        new, self.new, self.waiting = self.new, {}, 0
        for key in new:
            if len(key) > LONGEST:
                del self[key]
        return new

    def keep(self, key: str, ids: array) -> array:
        if len(key) <= LONGEST:
            self.bytes += ENTRY + 4 * (len(key) + len(ids))
        self[key] = ids
        return ids

    def age(self) -> None:
        if self.bytes > REMEMBERED // 2:
            self.old = dict(self)
            self.clear()
            self.bytes = 0

    def __missing__(self, key: str) -> array:
        if (out := self.old.get(key)) is not None:
            return self.keep(key, out)
        out = array("i", self.vocabulary.agenda(key if key[:1] == "\n" else SPACE + key.replace(" ", SPACE)))
        self.new[key] = out
        self.waiting += len(key) + 16
        return self.keep(key, out)


def _joined_blanks(parts: list[str]) -> list[str]:
    """Runs of blanks put together with the word that follows; those before a line end or the end stay alone."""
    out, blanks = [], 0
    for part in parts:
        if part == "":
            blanks += 1
        elif part[0] == "\n":
            if blanks:
                out.append(" " * (blanks - 1))
            out.append(part)
            blanks = 0
        else:
            out.append(" " * blanks + part)
            blanks = 0
    if blanks:
        out.append(" " * (blanks - 1))
    return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(docs: DataFrame, model_path: str | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with ids (array<int>) and decoded (what the ids decode to). Without keep_text neither text comes back; has_text says whether
    what was decoded isn't empty."""
    path = model_path or default_model()
    docs = replacing(docs, "ids", "decoded" if keep_text else "has_text")
    if not keep_text:
        docs = docs.select(*[named(c) for c in docs.columns if c != text_col], named(text_col))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        words = vocabulary(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, decoded, ends = [], [], [0]
                for text in batch.column(where):
                    found = words.encode(text.as_py() or "")
                    ids.append(np.array(found, dtype=np.int32))
                    ends.append(ends[-1] + len(found))
                    decoded.append(words.decode(found))
                words.check()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                yield batch, [lists, pa.array(decoded, pa.string()) if keep_text else pa.array([d != "" for d in decoded], pa.bool_())]

    ids = StructField("ids", ArrayType(IntegerType()))
    if keep_text:
        return with_arrays(docs, run, [ids, StructField("decoded", StringType())])
    return with_arrays(docs, run, [ids, StructField("has_text", BooleanType())], keep=where)


# ---------------------------------------------------------------- query
def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text"))
    out = encode_decode(docs)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

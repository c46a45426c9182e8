"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model has a whitespace marker after another character, so no merge crosses the start of a run of
markers: a text falls into marked words (a run of markers and what follows up to the next run), and the ids of the
text are the ids of its marked words in order. Each batch collects its distinct marked words, the library segments
those that the worker has not met before, and the ids go back to every position by one gather. The table lives in the
worker: dealing every occurrence out by word, to join with a global table, would shuffle several times the input.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafield.llm.common import append_columns

MARK = "▁"
_RUNS = re.compile(" ( *[^ ]*)")
#: Marked words and ids that a worker keeps, and the longest word that it keeps (characters). Others are segmented when met.
KEPT_WORDS, KEPT_IDS, KEPT_LENGTH = 400_000, 6_000_000, 48


def marked_words(text: str) -> list[str]:
    """Marked words of a text, each without its first marker; the library puts that one in front again."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _RUNS.findall(" " + text)
    return text.split(" ")


class WordTable:
    """Marked word -> ids, for one model file in one worker."""

    _loaded: dict[str, WordTable] = {}

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        #: False if a piece has a marker after another character; then whole texts go to the library.
        self.separable = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.lone = self.library.piece_to_id(MARK)
        self.reset()

    @classmethod
    def load(cls, model_path: str) -> WordTable:
        if model_path not in cls._loaded:
            cls._loaded[model_path] = cls(model_path)
        return cls._loaded[model_path]

    def reset(self) -> None:
        """Entry 0 is the end id."""
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.values = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.library.eos_id()], np.int32)

    def add(self, words: list[str]) -> None:
        """Segment words and append them to the table."""
        lists = [x if w else [self.lone] for w, x in zip(words, self.library.encode(words, num_threads=1), strict=True)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.index.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.values = np.concatenate([self.values, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str], end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and values of the ids of each text; entry 0 of the table is the end id."""
        if not self.separable:
            lists = [x + [self.library.eos_id()] * end for x in self.library.encode(texts, num_threads=1)]
            return np.cumsum([0, *map(len, lists)]), np.array([i for x in lists for i in x], dtype=np.int32)
        split = [marked_words(t) for t in texts]
        new = {w for words in split for w in words}.difference(self.index)
        if len(self.index) + len(new) > KEPT_WORDS or len(self.values) > KEPT_IDS:
            self.reset()
            new = {w for words in split for w in words}
        self.add(list(new))
        starts, sizes, values = self.starts, self.sizes, self.values
        find = self.index.__getitem__
        counts = np.fromiter((len(w) + end for w in split), dtype=np.int64, count=len(split))
        at = np.empty(int(counts.sum()), dtype=np.int64)
        place = 0
        for words in split:
            at[place : place + len(words)] = list(map(find, words))
            place += len(words)
            if end:
                at[place] = 0
                place += 1
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        gathered = values[np.repeat(starts[at] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])
        offsets = bounds[np.concatenate([[0], np.cumsum(counts)])]
        for w in [w for w in new if len(w) > KEPT_LENGTH]:
            del self.index[w]
        return offsets, gathered


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """df with column `ids` (array of int): exactly the ids that the library gives, then the end id if `end`.

    A null or empty text has no ids but the end id. Very long texts go through whole. Repeated rows stay; an existing
    column `ids` is replaced; an empty table gives an empty table.
    """

    def make():
        table = WordTable.load(model_path)

        def work(column: pa.Array) -> list[pa.Array]:
            offsets, values = table.encode([t or "" for t in column.to_pylist()], end)
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))]

        return work

    return append_columns(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with column `text`: what the library decodes from `ids`; null ids give an empty text."""

    def make():
        library = WordTable.load(model_path).library

        def work(column: pa.Array) -> list[pa.Array]:
            flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            return [pa.array([library.decode(flat[a:z]) if z > a else "" for a, z in zip([0, *ends[:-1]], ends, strict=True)], pa.string())]

        return work

    return append_columns(df, [ids], [T.StructField(text, T.StringType())], make)


def code(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", end: bool = True) -> DataFrame:
    """df with `ids` as encode() gives them and `decoded` as decode() does, by one worker, which holds the table once."""

    def make():
        table = WordTable.load(model_path)

        def work(column: pa.Array) -> list[pa.Array]:
            offsets, values = table.encode([t or "" for t in column.to_pylist()], end)
            flat, ends = values.tolist(), offsets.tolist()
            back = [table.library.decode(flat[a:z]) if z > a else "" for a, z in zip(ends[:-1], ends[1:], strict=True)]
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)), pa.array(back, pa.string())]

        return work

    return append_columns(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], make)


def ids_digest(ids: str):
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")).cast("binary"), 256)

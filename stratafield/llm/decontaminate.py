"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item is cut into windows of `window` consecutive words (a shorter item is one window). A window is a set of word
shingles with places. Shingles are ordered by how often they occur in all documents, rarest first. A window must be
contained whole, so its necessary prefix in that order is one shingle: a document holds the window only if it holds
the window's rarest one. Where it does, the shingle's place in the window and the window's length say where the window
would start and end; out of bounds is refused, and what is left is compared word for word.

Items go to the workers in blocks of a bounded number of bytes; a larger benchmark takes more blocks, each one more
step over the documents' rows, and none of them moves a document. Shingles of several blocks are counted in one reading.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafield.llm.common import append_columns, apart

#: A-Z to a-z; all that is not 0-9, a-z or past ASCII to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PRIME = 0x9E3779B97F4A7C15 | 1
#: Bytes of a text that are hashed at once, and bits of the filter before exact look-up.
SEGMENT, FILTER_BITS = 1 << 20, 22
#: Blocks whose shingles are counted in one reading of the documents; a shingle is a number to the driver and the tasks.
COUNTED_TOGETHER = 4
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def fold(text: str) -> bytes:
    """Lower-cased words of a text, one blank between them."""
    return b" ".join(text.encode().translate(_FOLD).split())


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        base, back = np.full(size, _PRIME, dtype=np.uint64), np.full(size, pow(_PRIME, -1, 1 << 64), dtype=np.uint64)
        base[0] = back[0] = 1
        _powers = np.cumprod(base), np.cumprod(back)
    return _powers


class Words:
    """Places of the words in folded text, and hashes of any run of words."""

    def __init__(self, folded: bytes):
        codes = np.frombuffer(folded, dtype=np.uint8)
        blanks = np.flatnonzero(codes == 32)
        self.text = folded
        self.starts = np.concatenate([[0], blanks + 1]) if len(codes) else np.empty(0, dtype=np.int64)
        self.ends = np.concatenate([blanks, [len(codes)]]) if len(codes) else np.empty(0, dtype=np.int64)
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of each run of k words, by its first word."""
        first, last = self.starts[: max(0, len(self) - k + 1)], self.ends[k - 1 :]
        return (self.sums[last] - self.sums[first]) * self.down[first]

    def run(self, at: int, k: int) -> bytes:
        return self.text[self.starts[at] : self.ends[at + k - 1]]


def segments(folded: bytes, overlap: int) -> Iterator[tuple[int, Words]]:
    """(index of its first word, words) of stretches of a folded text that share `overlap` words with the one before."""
    at, index, size = 0, 0, SEGMENT
    while True:
        end = len(folded) if at + size >= len(folded) else folded.rfind(b" ", at, at + size)
        if end <= at and end != len(folded):
            size *= 2
            continue
        words = Words(folded[at:end])
        if end == len(folded):
            yield index, words
            return
        if len(words) <= 2 * overlap:
            size *= 2
            continue
        yield index, words
        step = len(words) - overlap
        at, index = at + int(words.starts[step]), index + step


class Lookup:
    """Exact look-up of shingle hashes, behind a bit table."""

    def __init__(self, hashes: list[int]):
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        if hashes:
            self.bits[(np.array(hashes, dtype=np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.known = set(hashes)

    def places(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(place, hash) of those that are known."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        known = self.known
        return [(i, h) for i, h in zip(maybe.tolist(), hashes[maybe].tolist(), strict=True) if h in known]


class Block:
    """Windows of one block of the benchmark. windows: folded window -> ids of the items that have it."""

    def __init__(self, windows: dict[bytes, list], shingle: int):
        self.items = list(windows.values())
        self.texts = list(windows)
        self.lengths = [w.count(b" ") + 1 for w in self.texts]
        self.longest = max(self.lengths, default=1)
        self.sets = [(k := min(shingle, n), Words(w).shingles(k).tolist()) for w, n in zip(self.texts, self.lengths, strict=True)]
        self.prefix: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def shingles(self) -> dict[int, set[int]]:
        out: dict[int, set[int]] = defaultdict(set)
        for k, hashes in self.sets:
            out[k].update(hashes)
        return out

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Keep of each window its rarest shingle: (words, hash) -> windows and the shingle's place in them."""
        prefix = defaultdict(list)
        for w, (k, hashes) in enumerate(self.sets):
            _, h, place = min((frequency.get((k, h), 0), h, i) for i, h in enumerate(hashes))
            prefix[k, h].append((w, place))
        self.prefix, self.sets = dict(prefix), []  # the workers don't need the other shingles

    def search(self, folded: bytes, lookups: dict[int, Lookup]) -> tuple[int, list[list[int]], list]:
        """Words of a text, spans of words that are hit, ids of items with windows that occur."""
        if not folded:
            return 0, [], []
        found: set[tuple[int, int]] = set()
        total = 0
        for index, words in segments(folded, self.longest - 1):
            total = index + len(words)
            for k, lookup in lookups.items():
                for place, h in lookup.places(words.shingles(k)):
                    for w, offset in self.prefix[k, h]:
                        start, n = place - offset, self.lengths[w]
                        if start >= 0 and start + n <= len(words) and words.run(start, n) == self.texts[w]:
                            found.add((index + start, w))
        spans: list[list[int]] = []
        for start, w in sorted(found):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], start + self.lengths[w])
            else:
                spans.append([start, start + self.lengths[w]])
        return total, spans, sorted({i for _, w in found for i in self.items[w]})


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows: folded text, ids of the items that have it."""
    rows = benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text")).dropna()
    schema = T.StructType([T.StructField("window", T.BinaryType()), rows.schema["item"]])

    def cut(batches):
        for batch in batches:
            windows, at = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                words = fold(t).split()
                n = min(window, len(words))
                runs = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else ()
                windows += runs
                at += [row] * len(runs)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), batch.column(0).take(pa.array(at, pa.int64()))], names=["window", "item"])

    return rows.mapInArrow(cut, schema).groupBy("window").agg(F.collect_set("item").alias("items"))


def shingle_frequency(docs: DataFrame, text: str, wanted: dict[int, set[int]]) -> dict[tuple[int, int], int]:
    """How often the wanted shingles occur in all documents; tasks send one sum for each."""
    schema = "k int, h long, n long"

    def count(batches):
        lookups = {k: Lookup(list(hs)) for k, hs in wanted.items()}
        seen: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for index, words in segments(fold(t), max(wanted) - 1) if t else ():
                    for k, lookup in lookups.items():
                        for place, h in lookup.places(words.shingles(k)):
                            if not index or place + k > max(wanted) - 1:
                                seen[k, h] += 1
        keys = list(seen)
        signed = np.array([h for _, h in keys], dtype=np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array(signed), pa.array(list(seen.values()), pa.int64())], names=["k", "h", "n"])

    if not wanted:
        return {}
    sums = docs.select(F.col(f"`{text}`")).mapInArrow(count, schema).groupBy("k", "h").agg(F.sum("n").alias("n"))
    return {(r.k, r.h % (1 << 64)): r.n for r in sums.toLocalIterator()}


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 5, block_bytes: int = 32 << 20, share: float = 0.05) -> DataFrame:
    """docs with n_words, n_hit (long), spans (array of [from, to) word places), items (array of ids), contaminated.

    contaminated: a word is hit and hit words are `share` of all words at least. A null or empty text has no words and
    is clean. Items with a null id or text, or no words, take no part; items of one id count once. Documents are
    searched whole, repeated rows too; existing columns of these names are replaced; without items or documents the
    result has nothing hit or no rows. Spans and items of a very long text are as many as it holds.
    """
    windows = item_windows(benchmark, item_id, item_text, window)
    item_type = windows.schema["items"].dataType
    windows = windows.cache()
    size = windows.agg(F.sum(F.length("window") + 16 * F.size("items"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", item_type)]
    spans_type, items_type = pa.list_(pa.list_(pa.int64())), pa.list_(_arrow(item_type.elementType))
    out, parts, frequency = docs, [], {}

    def block_of(b: int) -> Block:
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).toLocalIterator()
        return Block({bytes(r.window): r["items"] for r in rows}, shingle)

    for b in range(blocks):
        block = block_of(b)
        if b % COUNTED_TOGETHER == 0:
            wanted = block.shingles()
            for more in range(b + 1, min(b + COUNTED_TOGETHER, blocks)):
                for k, hashes in block_of(more).shingles().items():
                    wanted[k] |= hashes
            frequency = shingle_frequency(docs, text, wanted)
        block.order(frequency)
        names = [f"__block{b}_{f.name}" for f in fields] if blocks > 1 else [f.name for f in fields]

        def make(block=block):
            by_k: dict[int, list[int]] = defaultdict(list)
            for k, h in block.prefix:
                by_k[k].append(h)
            lookups = {k: Lookup(hs) for k, hs in by_k.items()}

            def work(column: pa.Array) -> list[pa.Array]:
                found = [block.search(fold(t) if t else b"", lookups) for t in column.to_pylist()]
                return [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], spans_type), pa.array([x[2] for x in found], items_type)]

            return work

        out = append_columns(out, [text], [T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)], make)
        parts.append(names)
    windows.unpersist()
    if blocks > 1:

        def merge():
            def work(*columns: pa.Array) -> list[pa.Array]:
                lists = [c.to_pylist() for c in columns]
                n, spans, items = lists[0], [], []
                for row in range(len(n)):
                    joined: list[list[int]] = []
                    for a, z in sorted(s for k in range(1, len(lists), 3) for s in lists[k][row]):
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], z)
                        else:
                            joined.append([a, z])
                    spans.append(joined)
                    items.append(sorted({i for k in range(2, len(lists), 3) for i in lists[k][row]}))
                return [columns[0], pa.array(spans, spans_type), pa.array(items, items_type)]

            return work

        flat = [n for names in parts for n in names]
        out = append_columns(out, flat, fields, merge).drop(*flat)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return out.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / share) >= F.col("n_words")))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The clean documents, with their own columns and values, whatever their names."""
    return apart(docs, [text], lambda held, t: annotate(held, benchmark, t, **options).where(~F.col("contaminated")))

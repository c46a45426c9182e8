"""SimHash near-duplicates: linked fingerprints through hierarchical indexes in Gray order.

Equal fingerprints are one entry. With `blocks` blocks of bits and at most `distance` differing ones, two linked
fingerprints agree on blocks - distance blocks; each choice of that many blocks is a table, in which a fingerprint's
chosen bits come first. Entries that share the first of these, so many that some thousand entries do, are a group. A
group is sorted by Gray rank and indexed: runs of entries share a masked bit pattern, runs of runs a smaller one, and a
node holds only bits that its parent does not. A search adds up the differences on its way down, leaves a node once
they are too many, and takes it whole if even its free bits cannot make them too many. Of a group only a star of each component leaves the task, never its pairs.
A large group is cut into parts, and each pair of parts is a task. Distinct fingerprints in reach of each other are
limited by the number of bit patterns, so copies make no group larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafield.llm.common import append_columns, apart, materialize

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Shingles whose bits are counted at once; entries that are searched at once; node-entry pairs held at once.
CHUNK, TOGETHER, FRONTIER = 1 << 14, 1 << 14, 1 << 21
LEAF, FAN = 4, 8
#: Entries that share the bits of a group on average, while a table has so many bits to share.
GROUP = 1024


def fingerprint(text: str, words: int = 4) -> int:
    """Majority bits of the XXH64 hashes of the text's word shingles, repeats counted; 0 without words."""
    import xxhash

    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined, k = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = list(zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    digest, totals = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(pairs), CHUNK):
        hashes = b"".join([digest(joined[a:z], SEED) for a, z in pairs[at : at + CHUNK]])
        totals += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > len(pairs)).tobytes(), "big")


def add_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", words: int = 4) -> DataFrame:
    """df with the fingerprint as a long (two's complement); null texts have no words."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(t or "", words) for t in column.to_pylist()], dtype=np.uint64).astype(np.int64))]

        return work

    return append_columns(df, [text], [T.StructField(name, T.LongType())], make)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, z - a) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def blocks_for(entries: int, distance: int, most: int = 4 * GROUP) -> int:
    """Fewest blocks whose tables could have groups of `most` entries at most on average, were the bits random."""
    b = distance + 1
    while b < 2 * distance + 2 and entries / 2.0 ** (64 * (b - distance) / b) > most:
        b += 1
    return b


def first_bits(x: np.ndarray, chosen: tuple[int, ...], bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(bits of the chosen blocks, all bits with those of the chosen blocks in front)."""
    moved, key, width = np.zeros_like(x), np.zeros_like(x), 0
    order = [*chosen, *[i for i in range(len(bounds)) if i not in chosen]]
    for n, i in enumerate(order):
        low, size = bounds[i]
        part = (x >> np.uint64(low)) & np.uint64((1 << size) - 1)
        moved = (moved << np.uint64(size)) | part
        width += size
        if n < len(chosen):
            key = moved
    return key, moved


class GrayIndex:
    """Forest over sorted groups; level 0 has the runs of entries, each further level runs of nodes of one group."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes = codes
        self.visited = 0  # pairs of an entry and a node or entry that were compared
        self.levels = []  # of: first child, past the last child, fixed bits, pattern, first entry, past the last entry
        first, count, owner = np.arange(len(codes)), np.ones(len(codes), dtype=np.int64), group
        low, high = codes, codes  # bits that all have, bits that any has
        size = LEAF
        while True:
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            place = np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))
            cut = np.flatnonzero(place % size == 0)
            ends = np.append(cut[1:], len(owner))
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            last = (first + count)[ends - 1]
            first = first[cut]
            count, owner = last - first, owner[cut]
            self.levels.append({"from": cut, "to": ends, "fixed": ~(low ^ high), "pattern": low, "first": first, "last": last})
            if len(begins) == len(cut):
                break
            size = FAN
        for up, down in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            parent = np.repeat(np.arange(len(up["from"])), up["to"] - up["from"])
            down["own"] = down["fixed"] & ~up["fixed"][parent]
        self.levels[-1]["own"] = self.levels[-1]["fixed"]
        self.root = np.repeat(np.arange(len(self.levels[-1]["from"])), self.levels[-1]["last"] - self.levels[-1]["first"])

    def components(self, distance: int) -> np.ndarray:
        """For each entry the first entry of its component."""
        label = np.arange(len(self.codes))
        at, step = 0, 1024
        while at < len(self.codes):
            queries = np.arange(at, min(at + step, len(self.codes)))
            at += len(queries)
            self._search(queries, distance, label)
        return label

    def _search(self, queries: np.ndarray, distance: int, label: np.ndarray) -> None:
        q, node, far = queries, self.root[queries], np.zeros(len(queries), dtype=np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            self.visited += len(q)
            far = far + np.bitwise_count((self.codes[q] ^ level["pattern"][node]) & level["own"][node])
            # Too far; or all its entries come before the query, which has met them from their side.
            keep = (far <= distance) & (level["last"][node] > q + 1)
            # All its entries are in the query's component already.
            lows, highs = np.minimum.reduceat(label, level["first"]), np.maximum.reduceat(label, level["first"])
            keep &= ~((lows[node] == label[q]) & (highs[node] == label[q]))
            q, node, far = q[keep], node[keep], far[keep]
            whole = far + np.bitwise_count(~level["fixed"][node]) <= distance
            if whole.any():
                self._join(np.repeat(q[whole], (level["last"] - level["first"])[node[whole]]), _ranges(level["first"][node[whole]], level["last"][node[whole]]), label)
                q, node, far = q[~whole], node[~whole], far[~whole]
            sizes = (level["to"] - level["from"])[node]
            if sizes.sum() > FRONTIER and len(np.unique(q)) > 1:
                half = np.median(q)
                for side in (queries[queries <= half], queries[queries > half]):
                    if len(side):
                        self._search(side, distance, label)
                return
            node, q, far = _ranges(level["from"][node], level["to"][node]), np.repeat(q, sizes), np.repeat(far, sizes)
        self.visited += len(q)
        near = (node > q) & (np.bitwise_count(self.codes[q] ^ self.codes[node]) <= distance)
        self._join(q[near], node[near], label)

    @staticmethod
    def _join(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != (further := label[label])).any():
                label[:] = further


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = last - first
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - first, sizes)


def _spread(distinct: DataFrame, distance: int, blocks: int, entries: int) -> DataFrame:
    """(table, key, rank, code) of each fingerprint in each table."""
    bounds = block_bounds(blocks)
    tables = list(combinations(range(blocks), blocks - distance))
    wanted = max(0, (entries // GROUP).bit_length() - 1)

    def run(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for t, chosen in enumerate(tables):
                key, moved = first_bits(x, chosen, bounds)
                key = key >> np.uint64(max(0, sum(bounds[i][1] for i in chosen) - wanted))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array((gray_rank(moved) ^ np.uint64(1 << 63)).view(np.int64)), pa.array(x.view(np.int64))], names=["t", "key", "rank", "code"])

    return distinct.select("fp").mapInArrow(run, "t int, key long, rank long, code long")


def _stars(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Of sorted batches (t, key, i, j, rank, code): (entry, root) for each component of each group."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def search(groups: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        label = GrayIndex(codes, groups).components(distance) if len(codes) else np.empty(0, dtype=np.int64)
        far = np.flatnonzero(label != np.arange(len(codes)))
        return pa.RecordBatch.from_arrays([pa.array(codes[far].view(np.int64)), pa.array(codes[label[far]].view(np.int64))], names=["u", "v"])

    last, number = None, 0
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        codes = batch.column(5).to_numpy().astype(np.int64).view(np.uint64)
        if not len(codes):
            continue
        new = np.concatenate([[last is not None and last != tuple(int(c[0]) for c in columns)], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        groups = number + np.cumsum(new)
        last, number = tuple(int(c[-1]) for c in columns), int(groups[-1])
        held.append((groups, codes))
        if sum(len(g) for g, _ in held) >= TOGETHER:
            groups, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            done = int(np.searchsorted(groups, number))
            if done:
                yield search(groups[:done], codes[:done])
            held = [(groups[done:], codes[done:])]
    if held:
        yield search(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame, distance: int = 4, part: int = 2 * GROUP, blocks: int | None = None) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints (column fp) that span the components of the link graph.

    A group of more than `part` entries is cut into parts by a hash; each pair of parts is searched as one group.
    """
    entries = distinct.count()
    blocks = blocks or blocks_for(entries, distance)
    rows = _spread(distinct, distance, blocks, entries)
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > part).select("t", "key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    large = materialize(large, "large-groups")
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("code"), F.col("parts").cast("long")).cast("int")
    rows = rows.join(large, ["t", "key"], "left").withColumn("parts", parts).withColumn("mine", mine)
    rows = rows.select("t", "key", "rank", "code", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("yours"))
    rows = rows.select("t", "key", F.least("mine", "yours").alias("i"), F.greatest("mine", "yours").alias("j"), "rank", "code")
    rows = rows.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "rank")
    return rows.mapInArrow(lambda batches: _stars(batches, distance), "u long, v long").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of the edges (u, v): root is the smallest node that u reaches, itself included.

    Alternates large stars and small stars (Kiveris et al., Connected components in MapReduce and beyond, 2014); each
    round is written to the shared folder.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "small-star")


def _components(docs: DataFrame, doc_id: str, text: str, words: int, distance: int) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row; root is one fingerprint of the component."""
    marked = add_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__text")), "__text", "fp", words)
    marked = materialize(marked.select("doc_id", "fp"), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = materialize(roots(links(distinct, distance)), "roots")
    named = distinct.join(root.withColumnRenamed("u", "fp"), "fp")
    names = named.groupBy("root").agg(F.min("least").alias("named"))
    named = named.join(names, "root").select("fp", "root", "named")
    named = distinct.join(named, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest id whose fingerprint is reachable.

    Null and empty texts have fingerprint zero and are linked like any other. A row with a null id takes part, but
    names no component: component_id is null if no row of it has an id. Repeated rows stay. Other columns do not
    matter; an empty table gives an empty table.
    """
    return _components(docs, doc_id, text, words, distance).select("doc_id", "fp", "component_id")


def _hashable(kind: T.DataType) -> bool:
    inner = [kind.elementType] if isinstance(kind, T.ArrayType) else [f.dataType for f in kind] if isinstance(kind, T.StructType) else []
    return not isinstance(kind, (T.MapType, T.VariantType)) and all(map(_hashable, inner))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component, with its own columns and values.

    It is the row with the smallest id (any id before none); where several rows have that id, the one with the smallest
    fingerprint, then text, then hash of the other columns. So texts that are not linked stay though they share an id.
    """
    return apart(docs, [doc_id, text], lambda held, key, said: _keep_one(held, key, said, words, distance))


def _keep_one(docs: DataFrame, key: str, text: str, words: int, distance: int) -> DataFrame:
    found = materialize(_components(docs, key, text, words, distance), "document-components")
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "repeated")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    once = docs.where(F.col(key).isNotNull()).join(gone, F.col(key) == F.col("__gone"), "left_anti")
    if not again.take(1) and not found.where("doc_id is null").take(1):
        return once
    once = once.join(again, F.col(key) == F.col("__again"), "left_anti")
    # Rows that an id does not tell apart: a winner is named by its fingerprint, which is in one component only.
    unclear = found.where("doc_id is null and component_id is null").unionByName(found.where("doc_id = component_id").join(again, F.col("doc_id") == F.col("__again"), "left_semi"))
    winners = unclear.groupBy("root").agg(F.min("doc_id").alias("__id"), F.min("fp").alias("__winner")).drop("root")
    rest = docs.where(F.col(key).isNull()).unionByName(docs.join(again, F.col(key) == F.col("__again"), "left_semi"))
    rest = add_fingerprint(rest, text, "__fp", words)
    order = F.struct(F.col(text), F.xxhash64(*[c for c in docs.columns if _hashable(docs.schema[c].dataType)]))
    rest = rest.groupBy("__fp", F.col(key).alias("__key")).agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
    rest = rest.join(winners, (F.col("__fp") == F.col("__winner")) & F.col("__key").eqNullSafe(F.col("__id")), "left_semi")
    return once.unionByName(rest.select("__row.*"))

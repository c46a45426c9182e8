"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Rows fall into ranges of norm, each a power of two wide. Within a range vectors are scaled by its largest norm and given
one more component that makes their length one, queries are scaled to length one and given a zero there; then the
largest inner product is the smallest distance. A table hashes Gaussian projections into buckets of a fitted width. How
likely a bucket holds a neighbour follows from the query's places within its own buckets: a neighbour at distance r is
off by a normal deviate of scale r in each projection. A query visits its own bucket and perturbed ones from the
likeliest down to a likelihood that is fitted on a bounded sample so that the tables together find the neighbours; it
looks at buckets that hold rows only. How many projections there are grows with the logarithm of the rows.

Rows of equal vectors are one entry with as many of their smallest ids as can be among a query's nearest. Buckets are
dealt into shards by their first hashes, and so are queries: the first hashes alone rule out most shards where vectors
form groups. Hot shards are cut into slices by row. A shard's task scores the rows of visited buckets, keeps each
query's best and sums those again in double precision, in one order; the finds of all tables, ranges and slices are
merged by rank.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafield.llm.common import materialize

#: Queries whose likelihoods are held at once, and rows that are dealt out at once.
BLOCK, DEALT = 128, 1024
#: First hashes by which buckets are ruled out together, share of buckets that stay above which the others are looked at
#: for all queries at once, and pairs a bucket from which its scores are one product. None of them changes a result.
FRONT, DENSE, PAIRS_AT_ONCE = 4, 0.35, 64
_CODES = np.arange(-40, 40)  # buckets that are told apart; those beyond are the outermost


@dataclass(frozen=True)
class Index:
    """Of one range: tables x hashes projections; least: log likelihood from which a bucket is visited."""

    number: int
    dimension: int
    largest_norm: float
    hashes: int
    lead: int = 1
    shards: int = 1
    tables: int = 2
    distance: float = 1.0
    width: float = 1.5
    least: float = -np.inf
    seed: int = 7

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.tables, self.dimension + 1, self.hashes)), rng.uniform(size=(self.tables, self.hashes))

    def places(self, v: np.ndarray, t: int, asked: bool, projections) -> np.ndarray:
        """Places of stored vectors or of queries on the projections of a table, in buckets."""
        a, b = projections[0][t], projections[1][t]
        if asked:
            return (v / _lengths(v)) @ a[:-1] / self.width + b
        v = v / self.largest_norm
        return (v @ a[:-1] + np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1, keepdims=True))) * a[-1]) / self.width + b

    def codes(self, places: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(places), _CODES[0], _CODES[-1]).astype(np.int8)

    def likelihoods(self, places: np.ndarray, low: int = int(_CODES[0]), high: int = int(_CODES[-1])) -> np.ndarray:
        """(query, hash, code from low): log of the chance that a neighbour of a query falls into a bucket of a projection."""
        edges = np.arange(low, high + 2).astype(float)
        edges[edges == _CODES[0]], edges[edges == _CODES[-1] + 1] = -np.inf, np.inf
        below = _normal((edges - places[:, :, None]) * (self.width / self.distance))
        return np.log(np.maximum(np.diff(below, axis=2), 1e-30)).astype(np.float32)

    def shard_of(self, mixed: np.ndarray) -> np.ndarray:
        """From the sum of code * odd number over the first hashes."""
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int32)

    def mix(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).integers(1, 1 << 62, size=self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shards_of_codes(self, codes: np.ndarray) -> np.ndarray:
        k = self.lead
        return self.shard_of((codes[:, :k].astype(np.int64).view(np.uint64) * self.mix()[:k]).sum(axis=1, dtype=np.uint64))

    def shards_of_queries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) pairs: shards of which some bucket can be likely enough, going by the first hashes."""
        if self.shards == 1:
            return np.arange(len(places)), np.zeros(len(places), dtype=np.int32)
        chance = self.likelihoods(places)
        who, mixed, total = np.arange(len(places)), np.zeros(len(places), dtype=np.uint64), np.zeros(len(places), dtype=np.float32)
        for j, m in enumerate(self.mix()[: self.lead]):
            sums = total[:, None] + chance[who, j]
            at, code = np.nonzero(sums >= self.least)
            who, total = who[at], sums[at, code]
            mixed = mixed[at] + _CODES[code].astype(np.int64).view(np.uint64) * m
        pairs = np.unique(who * np.int64(self.shards) + self.shard_of(mixed))
        return pairs // self.shards, (pairs % self.shards).astype(np.int32)


def _lengths(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)
    return top * np.sqrt(((v / top) ** 2).sum(axis=1, keepdims=True))


_GRID = np.linspace(-8, 8, 1 << 14)
_BELOW = np.array([0.5 * (1 + erf(x / sqrt(2))) for x in _GRID])


def _normal(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, from a table."""
    return np.interp(x, _GRID, _BELOW, left=0.0, right=1.0)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = last - first
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - first, sizes)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def fit(number: int, norm: float, rows: int, sample: np.ndarray, k: int, target: float, shard_rows: int, exact_rows: int, queries: int = 256) -> Index:
    """Index of a range of `rows` rows from a sample of them.

    There are so many hashes that, were rows spread evenly over some three buckets of each, a bucket held about four.
    A row's neighbours in the sample are as many as there would be of its k nearest, so that they are as far away. Of
    the likelihoods of their buckets the least that reaches the target is taken. A range of few rows is visited whole.
    """
    d = sample.shape[1]
    index = Index(number, d, norm, hashes=max(2, min(16, ceil(log(max(rows, 4) / 4, 3)))))
    if rows <= exact_rows or len(sample) < 3:
        return Index(number, d, norm, hashes=2, tables=1)
    asked = sample[:queries]
    near = min(len(sample) - 1, max(1, ceil(k * len(sample) / rows)))
    scores = (asked / _lengths(asked)) @ (sample / norm).T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    nearest = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    away = 2 - 2 * np.take_along_axis(scores, nearest, 1)
    distance = float(max(1e-3, sqrt(max(0.0, away.mean()))))
    shards = max(1, ceil(rows / shard_rows))
    lead = min(index.hashes, max(1, ceil(log(shards, 3))))
    index = Index(number, d, norm, index.hashes, lead, shards, distance=distance, width=max(1.5 * distance, 0.12))
    projections, best = index.projections(), np.full(nearest.shape, -np.inf)
    for t in range(index.tables):
        codes = index.codes(index.places(sample, t, False, projections))
        chance = index.likelihoods(index.places(asked, t, True, projections))
        sums = sum(chance[np.arange(len(asked))[:, None], j, codes[nearest, j].astype(np.int64) - _CODES[0]].astype(float) for j in range(index.hashes))
        best = np.maximum(best, sums)
    least = float(np.sort(best.ravel())[int((1 - target) * best.size)]) - 1e-4
    return Index(number, d, norm, index.hashes, lead, shards, distance=distance, width=index.width, least=least)


def contenders(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the best rows, as many as it takes to have k ids besides `own`, or all rows if there are no more ids."""
    m = k + 1
    while m < len(scores):
        least = np.partition(scores, len(scores) - m)[len(scores) - m]
        near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
        found = set(ids[near].tolist())
        if len(found) - (own in found) >= k:
            return near
        m *= 4
    return np.arange(len(scores))


def first_of_each(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids, each id's best row only; ties go to smaller ids."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def best_of(ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and scores of the k nearest ids of some rows. Final scores are summed in one order for every row."""
    near = contenders(ids, scores, own, k)
    near = near[ids[near] != own]
    ids, vectors = ids[near], vectors[near]
    exact = (vectors * query).sum(axis=1)
    keep = first_of_each(ids, exact, k)
    return ids[keep], vectors[keep], exact[keep]


class Shard:
    """Entries (lists of ids, vectors, codes) of one shard of a table, by bucket; buckets with the same first codes follow each other."""

    def __init__(self, index: Index, lists: list[np.ndarray], vectors: np.ndarray, codes: np.ndarray):
        order = np.lexsort(codes.T[::-1])
        self.index, self.vectors = index, vectors[order]
        self.lists = [lists[i] for i in order.tolist()]
        self.buckets, first = np.unique(codes[order], axis=0, return_index=True)
        self.first, self.sizes = first, np.diff(np.append(first, len(order)))
        # Of each number of first codes, where buckets with the same ones begin, and past the last one.
        new = np.logical_or.accumulate(np.diff(self.buckets, axis=0, prepend=self.buckets[:1] - 1) != 0, axis=1)
        self.begins = [np.flatnonzero(new[:, j]) for j in range(new.shape[1])]
        self.ends = [np.append(b[1:], len(first)) for b in self.begins]
        self.low, self.high = int(self.buckets.min()), int(self.buckets.max())
        self.scored = 0  # pairs of a query and a row that were scored

    def _sums(self, chance: np.ndarray, codes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(chance), len(codes)), dtype=np.float32)
        for j in range(codes.shape[1]):
            total += chance[:, j, codes[:, j].astype(np.int64) - self.low]
        return total

    def visits(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, (query, bucket)): those that some query can visit, going by the first codes, and which it does."""
        if self.index.least == -np.inf:
            every = np.arange(len(self.buckets))
            return every, np.ones((len(places), len(every)), dtype=bool)
        chance = self.index.likelihoods(places, self.low, self.high)
        depth = min(FRONT, self.buckets.shape[1]) - 1
        begins, ends = self.begins[depth], self.ends[depth]
        sums = self._sums(chance, self.buckets[begins, : depth + 1])
        near = sums >= self.index.least
        if near.sum(axis=0) @ (ends - begins) > DENSE * near.shape[0] * len(self.buckets):
            some = np.flatnonzero(np.repeat(near.any(axis=0), ends - begins))
            return some, self._sums(chance, self.buckets[some]) >= self.index.least
        who, node = np.nonzero(near)
        total = sums[who, node]
        for j in range(depth + 1, self.buckets.shape[1]):
            # From groups of buckets with the same j first codes to those with the same j + 1.
            first = np.searchsorted(self.begins[j], self.begins[j - 1][node])
            last = np.searchsorted(self.begins[j], self.ends[j - 1][node])
            who, total = np.repeat(who, last - first), np.repeat(total, last - first)
            node = _ranges(first, last)
            total += chance[who, j, self.buckets[self.begins[j][node], j].astype(np.int64) - self.low]
            there = total >= self.index.least
            who, node, total = who[there], node[there], total[there]
        some, place = np.unique(node, return_inverse=True)
        seen = np.zeros((len(places), len(some)), dtype=bool)
        seen[who, place] = True
        return some, seen

    def search(self, own: np.ndarray, asked: np.ndarray, places: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[float]]]:
        """The best finds of each query, by exact score. Queries of the same first codes are looked up together."""
        order = np.lexsort(self.index.codes(places)[:, ::-1].T)
        for at in range(0, len(order), BLOCK):
            mine = order[at : at + BLOCK]
            some, seen = self.visits(places[mine])
            used = seen.any(axis=0)
            some, seen = some[used], seen[:, used]
            if not len(some):
                continue
            rows = _ranges(self.first[some], self.first[some] + self.sizes[some])
            ends = np.cumsum(self.sizes[some])
            scores = self._scores(asked[mine], rows, seen, ends)
            m = min(k + 1, len(rows))
            least = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
            for q in range(len(mine)):
                bound = least[q] - 1e-9 * max(1.0, abs(least[q])) if least[q] > -np.inf else -np.inf
                near = np.flatnonzero((scores[q] >= bound) & (scores[q] > -np.inf))
                if len(near):
                    yield self._best(int(own[mine[q]]), asked[mine[q]], near, rows, scores[q], k)

    def _scores(self, asked: np.ndarray, rows: np.ndarray, seen: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(query, row): inner products where the row's bucket is visited; bucket by bucket, or pair by pair where few queries meet in one."""
        sizes = np.diff(ends, prepend=0)
        scores = np.full((len(asked), len(rows)), -np.inf)
        pairs = int(seen.sum(axis=0) @ sizes)
        self.scored += pairs
        if pairs > PAIRS_AT_ONCE * len(ends):
            for c, (f, e) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                who = np.flatnonzero(seen[:, c])
                scores[who, f:e] = asked[who] @ self.vectors[rows[f:e]].T
            return scores
        who, bucket = np.nonzero(seen)
        at = _ranges((ends - sizes)[bucket], ends[bucket])
        who = np.repeat(who, sizes[bucket])
        for f in range(0, len(at), 1 << 14):
            w, r = who[f : f + (1 << 14)], at[f : f + (1 << 14)]
            scores[w, r] = np.einsum("ij,ij->i", asked[w], self.vectors[rows[r]])
        return scores

    def _best(self, own: int, query: np.ndarray, near: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[int, list[int], list[float]]:
        while True:
            exact = (self.vectors[rows[near]] * query).sum(axis=1)
            lists = [self.lists[i] for i in rows[near].tolist()]
            ids, each = np.concatenate(lists), np.repeat(exact, [len(x) for x in lists])
            there = ids != own
            keep = first_of_each(ids[there], each[there], k)
            if len(keep) == k or len(near) == int((scores > -np.inf).sum()):
                return own, ids[there][keep].tolist(), each[there][keep].tolist()
            # Ids that are on several entries took places: look at four times as many.
            m = min(4 * len(near), len(scores))
            near = np.argpartition(-scores, m - 1)[:m]
            near = np.sort(near[scores[near] > -np.inf])


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def _found_batch(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.float64()))], names=_FOUND.names)


def _tasks(batches: Iterator[pa.RecordBatch], indexes: dict[int, Index], k: int) -> Iterator[pa.RecordBatch]:
    """Of batches (g, t, s, slice, asks, ids, vector), sorted by the first five: what each group's queries find."""
    key, rows, shard = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
        cuts = np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=keys[:1] - 1), axis=1))
        for a, z in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
            part, here = batch.slice(a, z - a), tuple(keys[a, :4])
            if key != here:
                key, rows, shard = here, [], None
                index = indexes[int(here[0])]
                projections = index.projections()
            vectors, t = _matrix(part.column(6), index.dimension), int(here[1])
            ids, sizes = part.column(5).flatten().to_numpy(), part.column(5).value_lengths().to_numpy()
            if not keys[a, 4]:
                rows.append((np.split(ids, np.cumsum(sizes)[:-1]), vectors))
                continue
            if shard is None and rows:
                held = np.concatenate([v for _, v in rows])
                shard = Shard(index, [x for lists, _ in rows for x in lists], held, index.codes(index.places(held, t, False, projections)))
            if shard is not None:
                for f in range(0, len(ids), 4096):
                    asked = vectors[f : f + 4096]
                    found = list(shard.search(ids[f : f + 4096], asked, index.places(asked, t, True, projections), k))
                    if found:
                        yield _found_batch(found)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vector, norm) of rows that take part. Vectors of floats stay such, others are doubles."""
    kind = vectors.select(F.col(f"`{embedding}`").alias("v")).schema["v"].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<float>" if floats else "array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    rows = rows.withColumn("top", top).where("top > 0")
    share = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") / F.col("top")) * (x.cast("double") / F.col("top")))
    return rows.select("id", "vector", F.least(F.col("top") * F.sqrt(share), F.lit(sys.float_info.max)).alias("norm"))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(ids, vector, norm): one for each distinct vector, with its k + 1 smallest ids; no more can be among k nearest.

    Only rows whose vector's hash occurs again are brought together, and of those each task sends its smallest ids only.
    """
    hashed = rows.withColumn("h", F.xxhash64("vector"))
    again = materialize(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-vectors")
    if not again.take(1):
        return rows.select(F.array("id").alias("ids"), "vector", "norm")
    alone = hashed.join(again, "h", "left_anti").select(F.array("id").alias("ids"), "vector", "norm")
    shared = hashed.join(again, "h", "left_semi").select("id", "vector", "norm").distinct()
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    shared = shared.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return alone.unionByName(shared.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("norm").alias("norm")).select("ids", "vector", "norm"))


def nearest(vectors: DataFrame, asks, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = 8192, sample_rows: int = 8192, target: float = 0.94, exact_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among all other rows; `asks`: condition on column id.

    Null vectors, zero vectors, vectors with null or non-finite components, rows with a null id and rows of another
    length than most take no part. Ties go to the smaller id. Repeated rows of an id count once and never as their own
    neighbour: equal rows are made one first, and of rows that differ the best counts. A query that finds fewer than k
    is searched again against every row. An empty table gives no rows. Other columns do not matter. `target`: share of
    the neighbours in a sample of `sample_rows` rows that is to be found; `exact_rows`: rows of a range of norms that
    are visited whole.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    d = sizes[0].d
    rows = rows.where(F.size("vector") == d)
    stored = materialize(entries(rows, k).withColumn("g", F.floor(F.log2("norm")).cast("int")), "vector-entries")
    ranges = {r.g: (r.n, r.top) for r in stored.groupBy("g").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}  # at most one for each exponent of a double
    most = max(64, min(sample_rows, (64 << 20) // (8 * d * len(ranges))))
    samples = {g: np.stack(x["vector"].to_numpy()).astype(float) for g, x in _sample(stored, ranges, most).groupby("g")}
    none = np.empty((0, d))
    indexes = {g: fit(g, top, n, samples.get(g, none), k, target, shard_rows, exact_rows) for g, (n, top) in ranges.items()}
    element = stored.schema["vector"].dataType
    small = pa.list_(pa.float32() if isinstance(element.elementType, T.FloatType) else pa.float64())

    def deal(is_query: bool):
        def run(batches):
            projections = {g: x.projections() for g, x in indexes.items()}
            for whole in batches:
                for at in range(0, whole.num_rows, DEALT):
                    batch = whole.slice(at, DEALT)
                    v, carried = _matrix(batch.column(1), d), batch.column(1).cast(small)
                    own = batch.column(2).to_numpy() if not is_query else None
                    for g, index in indexes.items():
                        mine = np.arange(len(v)) if is_query else np.flatnonzero(own == g)
                        if not len(mine):
                            continue
                        for t in range(index.tables):
                            places = index.places(v[mine], t, is_query, projections[g])
                            who, shards = index.shards_of_queries(places) if is_query else (np.arange(len(mine)), index.shards_of_codes(index.codes(places)))
                            at_row, n = pa.array(mine[who]), len(who)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(shards), batch.column(0).take(at_row), carried.take(at_row)], names=["g", "t", "s", "ids", "vector"])

        return run

    schema = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("g", "t", "s")], T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("vector", element)])
    dealt = stored.select("ids", "vector", "g").mapInArrow(deal(False), schema)
    asking = materialize(rows.where(asks).select("id", "vector").distinct(), "queries")
    queries = asking.select(F.array("id").alias("ids"), "vector").mapInArrow(deal(True), schema)
    # Shards over the size that they have on average are cut into slices; a query goes to every slice.
    cuts = dealt.groupBy("g", "t", "s").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows).select("g", "t", "s", F.ceil(F.col("n") / shard_rows).cast("int").alias("slices"))
    cuts = materialize(cuts, "large-shards")
    slices = F.coalesce("slices", F.lit(1))
    dealt = dealt.join(cuts, ["g", "t", "s"], "left").withColumn("slice", F.pmod(F.xxhash64("vector"), slices.cast("long")).cast("int")).withColumn("asks", F.lit(0))
    queries = queries.join(cuts, ["g", "t", "s"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("asks", F.lit(1))
    by = ["g", "t", "s", "slice"]
    columns = [*by, "asks", "ids", "vector"]
    both = dealt.select(columns).unionByName(queries.select(columns)).repartition(*by).sortWithinPartitions(*by, "asks")
    best = materialize(_merge(both.mapInArrow(lambda batches: _tasks(batches, indexes, k), _FOUND), k), "nearest")
    short = asking.select(F.col("id").alias("query_id")).distinct().join(best.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    short = materialize(asking.join(short.withColumnRenamed("query_id", "id"), "id", "left_semi"), "short-queries")
    m = short.count()
    if m:
        best = best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
        blocks = max(1, ceil(m * 8 * d / (16 << 20)))
        for block in range(blocks):  # each of 16 MB or so
            part = short.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
            if len(part):
                best = best.unionByName(_merge(_against_all(stored, part["id"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(float), d, k), k))
    return best.select("query_id", "rank", "vec_id", "score")


def _sample(stored: DataFrame, ranges: dict[int, tuple[int, float]], most: int):
    """About `most` entries of each range, by hash: as many as a share of it gives, all of a small one."""
    keep = F.lit(False)
    for g, (n, _) in ranges.items():
        share = min(1.0, most / n)
        keep = keep | ((F.col("g") == g) & (F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(1 << 20)) < ceil(share * (1 << 20))))
    return stored.where(keep).select("g", "vector").orderBy(F.xxhash64("vector")).limit(2 * most * len(ranges)).toPandas()  # bounded


def _against_all(stored: DataFrame, own: np.ndarray, asked: np.ndarray, d: int, k: int) -> DataFrame:
    """A block of queries against every entry; each task keeps the best of what it has read so far."""

    def run(batches):
        best: list[tuple] = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(own)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors = _matrix(batch.column(1), d)
                ids, sizes = batch.column(0).flatten().to_numpy(), batch.column(0).value_lengths().to_numpy()
                entry = np.repeat(np.arange(len(vectors)), sizes)
                scores = asked @ vectors.T
                for q in range(len(own)):
                    i, _, s = best_of(ids, vectors[entry], int(own[q]), asked[q], scores[q][entry], k)
                    i, s = np.concatenate([best[q][0], i]), np.concatenate([best[q][1], s])
                    keep = first_of_each(i, s, k)
                    best[q] = (i[keep], s[keep])
        yield _found_batch([(int(q), i.tolist(), s.tolist()) for q, (i, s) in zip(own, best, strict=True)])

    return stored.select("ids", "vector").mapInArrow(run, _FOUND)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all that was found for a query, each id once."""
    each = found.repartition("query_id").select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    each = each.groupBy("query_id", F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

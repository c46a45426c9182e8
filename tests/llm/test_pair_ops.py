import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratafield.llm import decontaminate, nearest, queries, simhash

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for i, t in items:
        if i is None or t is None:
            continue
        item = WORD.findall(t.translate(LOWER))
        n = min(13, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                ids.add(i)
    return len(words), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 400, "shingle": 3}])
def test_decontamination_equals_brute_force(spark, edge_docs, options, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(decontaminate, "SEGMENT", 300)
    items = [(i, prose(rng, k)) for i, k in enumerate((40, 13, 14, 5, 1, 12, 20))] + [(7, None), (None, "zeta"), (8, ""), (9, "..."), (0, prose(rng, 15)), (10, prose(rng, 20))]
    items.append((11, items[0][1]))
    docs = [prose(rng, 50) + " " + items[0][1][20:-9] + " " + prose(rng, 9), items[1][1].upper() + "!!" + items[10][1], items[4][1], prose(rng, 3000) + " " + items[6][1] + prose(rng, 90), (items[0][1] + " ") * 30]
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(docs)], "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text").where("doc_id <> 10"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(df, benchmark, **options).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) == contamination(r.text, items), (r.doc_id, r.text[:80])
    clean = decontaminate.annotate(edge_docs, benchmark.limit(0))
    assert clean.where("n_hit > 0 or contaminated").count() == 0 and clean.columns.count("n_words") == 1
    assert decontaminate.annotate(df.limit(0), benchmark).count() == 0
    assert decontaminate.drop_contaminated(edge_docs, benchmark).columns == edge_docs.columns


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if words else 0


def spanning(codes, distance):
    label = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def test_simhash_equals_brute_force(spark, edge_docs):
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(12)]
    docs = []
    for b in base:
        words = b.split(" ")
        for _ in range(4):
            docs.append(" ".join(words[: rng.randint(54, 60)]))
    df = edge_docs.select(F.col("doc_id"), "text", F.lit(1).alias("fp")).unionByName(spark.createDataFrame([(500 - i, t, 0) for i, t in enumerate(docs)] + [(None, docs[0], 0), (None, "only here " * 9, 0)], "doc_id long, text string, fp int"))
    rows = simhash.components(df).collect()
    assert len(rows) == df.count()
    texts = df.collect()
    want = [fingerprint(r.text) for r in texts]
    assert sorted(want) == sorted(r.fp % (1 << 64) for r in rows)
    codes = sorted(set(want))
    label = dict(zip(codes, spanning(codes, 4), strict=True))
    least = {}
    for r, c in zip(texts, want, strict=True):
        if r.doc_id is not None:
            least[label[c]] = min(r.doc_id, least.get(label[c], r.doc_id))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == sorted((r.doc_id or -1, least.get(label[c]) or -1) for r, c in zip(texts, want, strict=True))
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(label.values())) and simhash.keep_one(df).columns == df.columns
    assert simhash.components(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("part,blocks", [(1500, 5), (20, 5), (7, 6)])
def test_links_span_the_same_components(spark, part, blocks):
    rng = random.Random(part)
    centre = rng.getrandbits(64)
    codes = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(120):
        x = centre
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        codes.add(x)
    codes = sorted(codes)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    roots = {r.u % (1 << 64): r.root for r in simhash.roots(simhash.links(df, 4, part, blocks)).collect()}
    label = spanning(codes, 4)
    groups, found = {}, {}
    for c, x in zip(codes, label, strict=True):
        groups.setdefault(x, set()).add(c)
        found.setdefault(roots.get(c, ("alone", c)), set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_upper_nodes_prune_whole_groups():
    """In one group of the size that groups have, few of all pairs are compared, and fewer than without upper nodes."""
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 63, simhash.GROUP, dtype=np.uint64) * np.uint64(2)
    codes = np.unique(np.concatenate([codes, codes[:300] ^ (np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64))]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex(codes, np.zeros(len(codes), dtype=np.int64))
    label = index.components(4)
    assert [int(x) for x in label] == [min(j for j, y in enumerate(spanned) if y == x) for spanned in [spanning(codes.tolist(), 4)] for x in spanned]
    nodes = sum(len(level["from"]) for level in index.levels)
    assert len(index.levels) > 3 and nodes > len(codes) / simhash.LEAF
    assert index.visited < 0.4 * len(codes) ** 2 / 2


@pytest.mark.parametrize("group", [1, 8, 1024])
def test_groups_of_any_size_find_the_same_links(spark, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)
    test_links_span_the_same_components(spark, 40, 5)


def test_gray_order():
    x = np.arange(64, dtype=np.uint64)
    codes = x ^ (x >> np.uint64(1))
    assert (simhash.gray_rank(codes) == x).all()


def exact(rows, k):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            scored = sorted((-float(sum(np.float64(a) * np.float64(b) for a, b in zip(v, w, strict=True))), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_nearest_finds_nearly_all(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[100:200] = v[100]  # ties
    v[200:300] *= rng.uniform(0.2, 3, size=(100, 1)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [1.0] * 15 + [None]), (2060, [float("nan")] + [1.0] * 15), (2080, [float("inf")] + [1.0] * 15), (2100, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = {}
    for r in nearest.nearest(df, F.col("id") % 20 == 0, k=10, shard_rows=150).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(rows, 10)
    assert got.keys() == want.keys()
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    scores = {q: dict(want[q]) for q in want}
    assert all(abs(s - scores[q][j]) < 1e-9 for q in got for j, s in got[q] if j in scores[q])
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) and q not in {j for j, _ in x} for q, x in got.items())
    tied = [j for j, _ in got[100] if 100 < j < 200]
    assert tied and tied == list(range(101, 101 + len(tied)))


def test_repeated_ids_take_no_places():
    """More copies of a neighbour, or of the query itself, than there are places."""
    rng = np.random.default_rng(8)
    v, k = rng.normal(size=(300, 8)), 20
    ids = np.arange(300)
    want = np.lexsort((ids[1:], -(v[1:] @ v[0])))[:k] + 1
    for many in (ids[:1], want[:1], want[:3]):
        i, w = np.concatenate([ids, np.repeat(many, 400)]), np.concatenate([v, np.repeat(v[many], 400, axis=0)])
        got, _, scores = nearest.best_of(i, w, 0, v[0], w @ v[0], k)
        assert got.tolist() == want.tolist() and np.allclose(scores, v[want] @ v[0])


@pytest.mark.parametrize("differ", [0.0, 1e-3])
def test_nearest_with_repeated_ids(spark, differ):
    """Exact where a query visits few others than its copies: it is searched against every row."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(80, 8))
    v[1:4] = v[0] + rng.normal(size=(3, 8)) * 0.01
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(i, (v[i] * (1 + differ * n / 60)).tolist()) for i in (0, 1, 20) for n in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, F.col("id") % 20 == 0, k=5, target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 20, 40, 60):
        best = {}
        for own in (x for i, x in rows if i == q):
            for j, w in rows:
                if j != q:
                    best[j] = max(best.get(j, -np.inf), float(np.dot(own, w)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [j for j, _ in got[q]] == [j for j, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want])


def groups(rng, n, d=32):
    centres = rng.normal(size=(n // 40, d))
    v = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * 0.3
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def work(v, k=20):
    """(scored pairs by all pairs, recall) of the index over vectors of one range, without Spark."""
    n, ids = len(v), np.arange(len(v))
    index = nearest.fit(0, 1.0 + 1e-9, n, v[np.random.default_rng(1).permutation(n)[:2000]], k, 0.94, 1000, 256)
    projections, queries, scored, found = index.projections(), np.arange(0, n, 20), 0, {}
    for t in range(index.tables):
        places, asked = index.places(v, t, False, projections), index.places(v[queries], t, True, projections)
        shards = index.shards_of_codes(index.codes(places))
        who, wanted = index.shards_of_queries(asked)
        for s in np.unique(shards):
            mine, here = np.flatnonzero(shards == s), who[wanted == s]
            shard = nearest.Shard(index, [ids[i : i + 1] for i in mine], v[mine], index.codes(places[mine]))
            for own, i, x in shard.search(queries[here], v[queries][here], asked[here], k):
                found.setdefault(own, {}).update(zip(i, x, strict=True))
            scored += shard.scored
    hits = []
    for q in queries.tolist():
        scores = v @ v[q]
        scores[q] = -9
        best = sorted(found.get(q, {}), key=lambda i, q=q: -found[q][i])[:k]
        hits.append(len(set(best) & set(np.argpartition(-scores, k)[:k].tolist())) / k)
    return scored / len(queries) / n, np.mean(hits)


def test_index_scores_few_rows_where_vectors_form_groups():
    """At most 0.15 and 0.05 of all pairs are scored, so the work grows far slower than the square."""
    rng = np.random.default_rng(14)
    small, large = work(groups(rng, 3000)), work(groups(rng, 12000))
    assert small[1] >= 0.9 and large[1] >= 0.9
    assert small[0] <= 0.15 and large[0] <= 0.05 and large[0] < 0.5 * small[0]


def test_buckets_are_the_same_however_they_are_looked_up(monkeypatch):
    v = groups(np.random.default_rng(15), 1500)
    want = work(v)
    for depth, dense, pairs in ((1, 0.0, 0), (2, 2.0, 10**9), (9, 0.5, 64)):
        monkeypatch.setattr(nearest, "FRONT", depth)
        monkeypatch.setattr(nearest, "DENSE", dense)
        monkeypatch.setattr(nearest, "PAIRS_AT_ONCE", pairs)
        assert work(v) == want


def test_long_vectors_are_found_and_do_not_hide_others(spark):
    """A vector of norm 1000 among others of norm 1, tiny ones, and one vector under many ids."""
    rng = np.random.default_rng(16)
    v = groups(rng, 1200, 16)
    v[7] *= 1000
    v[400:410] *= 1e-200
    v[600:900] = v[600]
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, F.col("id") % 20 == 0, k=10, shard_rows=200, exact_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = []
    for q in range(0, 1200, 20):
        scores = v @ v[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(1200), -scores))[:10].tolist()
        hits.append(len(set(want) & set(got[q])) / 10)
        if v[7] @ v[q] > 0 and q != 7:
            assert got[q][0] == 7
        if 600 <= q < 900:
            assert [i for i in got[q] if i != 7][:8] == [i for i in range(600, 610) if i != q][:8]
    assert np.mean(hits) >= 0.9


def test_nearest_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [-1.0, 0.0])], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest.nearest(few, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 20), (20, 1, 2), (20, 2, 3), (20, 3, 0)]
    assert nearest.nearest(few.limit(0), F.col("id") >= 0).count() == 0
    assert nearest.nearest(few.limit(1), F.col("id") >= 0).count() == 0


def test_queries_on_the_smallest_tables(spark):
    """Every query runs over whole tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_decontamination", "op3_toxicity", "op4_sentencepiece", "op5_simhash", "op6_pii", "op7_token_counts", "op9_license_scan"):
        assert queries.QUERIES[name](spark, sf).count() == docs, name

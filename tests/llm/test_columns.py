"""Callers' columns whose names are the operators' own, in another case and of another type."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratafield.llm import decontaminate, license_scan, pii, sentencepiece_codec, simhash, token_counts, toxicity, url_filter
from stratafield.llm.common import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
LEXICON = toxicity.Lexicon({" moron": 5.0}, (-3.0, 4.0, 0.0, 0.0))
CLASHING = ["Score", "PREDICTED", "N_words", "n_HIT", "Spans", "ITEMS", "Contaminated", "Licenses", "Pii", "IDS", "Decoded", "N_bytes", "N_Tokens", "Over_limit", "FP", "Component_id", "root", "least", "__text", "__fp", "__id", "__row", "__key", "__again", "__winner", "Host", "PATH", "Template", "Purity", "rule", "Verdict", "__host", "__s1", "count", "h"]
TEXTS = ["the river is wide and the stones are cold today", "such a moron", "", None, "item words one two three four five six seven eight nine ten eleven twelve", "the river is wide and the stones are cold today"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, f"mine {i}") for i, t in enumerate(TEXTS)], "doc_id long, text string, tag string")
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) if k % 2 else F.col("doc_id") + 0.5 for k, c in enumerate(CLASHING)})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Item words one two three four five six seven eight nine ten eleven.")], "item_id long, text string")


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=str)


def test_operators_add_to_other_columns(docs, benchmark):
    runs = {
        "score": (lambda d: toxicity.score(d, LEXICON), ["score", "predicted"]),
        "annotate": (lambda d: decontaminate.annotate(d, benchmark), ["n_words", "spans", "items", "n_hit", "contaminated"]),
        "annotate in blocks": (lambda d: decontaminate.annotate(d, benchmark.unionByName(benchmark.select(F.col("item_id") + 1, F.lit("another item of words").alias("text")).toDF("item_id", "text")), block_bytes=60), ["n_words", "spans", "items", "n_hit", "contaminated"]),
        "scan": (license_scan.scan, ["licenses"]),
        "pseudonymise": (lambda d: pii.pseudonymise(d, b"k"), ["text", "pii"]),
        "code": (lambda d: sentencepiece_codec.code(d, MODEL), ["ids", "decoded"]),
        "count_tokens": (lambda d: token_counts.count_tokens(d, MODEL), ["n_bytes", "n_tokens", "over_limit"]),
        "filter_urls": (lambda d: url_filter.filter_urls(d, "text"), ["host", "path", "template", "purity", "rule", "verdict"]),
    }
    for name, (run, made) in runs.items():
        others = [c for c in docs.columns if c.lower() not in made]
        out = run(docs)
        assert [c for c in out.columns if c.lower() not in made] == others and sorted(set(out.columns) - set(others)) == sorted(made), name
        assert rows(out, others) == rows(docs, others), name


def test_filters_give_back_the_callers_values(docs, benchmark):
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, out, ids in (
        ("drop_toxic", toxicity.drop_toxic(docs, LEXICON), {0, 2, 3, 4, 5}),
        ("drop_contaminated", decontaminate.drop_contaminated(docs, benchmark), {0, 1, 2, 3, 5}),
        ("keep_one", simhash.keep_one(docs), {0, 1, 2, 4}),
    ):
        assert out.columns == docs.columns, name
        assert {r.doc_id: tuple(r) for r in out.collect()} == {i: whole[i] for i in ids}, name


def test_stages_give_back_the_callers_values(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = docs.withColumn("n_chars", F.length("text").cast("long"))
    whole = {r.doc_id: tuple(r) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.schema == df.schema, name
        assert all(tuple(r) == whole[r.doc_id] for r in out.collect()), name
    assert corpus_pipeline.encoding(spark, df, str(tmp_path)).count() == df.count()


def test_text_column_of_an_output_name(docs):
    df = docs.select("doc_id", F.col("text").alias("n_bytes"))
    assert sorted((r.doc_id, r.n_bytes) for r in token_counts.count_tokens(df, MODEL, "n_bytes").collect()) == [(i, len((t or "").encode())) for i, t in enumerate(TEXTS)]


def test_one_of_rows_that_share_an_id(spark):
    """Texts that are not linked stay, of those that are linked the same one every time, and rows without an id too."""
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five six " * 9, "rot blau grün gelb schwarz " * 9)
    data = [(5, a, "x"), (5, b, "y"), (5, a, "w"), (6, b, "z"), (4, c, "u"), (4, c, "t"), (None, "only here " * 9, "s"), (None, "only here " * 9, "r"), (None, a, "q"), (7, "only there and now " * 9, "p")]
    schema = "doc_id long, text string, more string"
    seen = set()
    for k in range(3):
        df = spark.createDataFrame(data[k:] + data[:k], schema).withColumn("bag", F.create_map(F.lit("a"), F.lit(k * 0))).repartition(k + 1)
        kept = simhash.keep_one(df).collect()
        seen.add(tuple(sorted((r.doc_id or -1, r.text, r.more) for r in kept)))
        assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(5, a), (5, b), (4, c), (-1, "only here " * 9), (7, "only there and now " * 9)])
    assert len(seen) == 1

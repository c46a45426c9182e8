import math
import os
import re

import pytest
import sentencepiece

import corpus_pipeline
from stratafield.llm import toxicity
from stratafield.llm.common import tokenizer_path

from .test_pair_ops import contamination, fingerprint, spanning
from .test_text_ops import plain_weight

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    lexicon = toxicity.learn(docs, labels)
    rows = [r for r in docs.collect() if probability(r.text or "", lexicon) < 0.7]
    codes = [fingerprint(r.text) for r in rows]
    distinct = sorted(set(codes))
    label = dict(zip(distinct, spanning(distinct, 4), strict=True))
    least: dict = {}
    for r, c in zip(rows, codes, strict=True):
        least[label[c]] = min(r.doc_id, least.get(label[c], r.doc_id))
    rows = [r for r, c in zip(rows, codes, strict=True) if least[label[c]] == r.doc_id]
    benchmark = [(r.item_id, r.text) for r in items.collect()]
    rows = [r for r in rows if not contamination(r.text, benchmark)[3]]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == {r.doc_id for r in rows} and 0 < len(got) < docs.count()
    changed = 0
    for r in rows:
        new, spans = got[r.doc_id].text, PRIVATE.findall(r.text)
        changed += bool(spans)
        # All that is not private is there, in order, and between it stands something else of the same form.
        kept = PRIVATE.split(r.text)
        m = re.fullmatch("(.*?)".join(map(re.escape, kept)), new, re.DOTALL)
        assert m and all(a != b and form(a) == form(b) for a, b in zip(spans, m.groups(), strict=True))
        assert got[r.doc_id].ids == library.encode(new) + [library.eos_id()] and got[r.doc_id].decoded == library.decode(got[r.doc_id].ids)
    assert changed > 3


#: The private values of the test tables: addresses, keys, numbers of phones, and cards and internet addresses that are valid.
PRIVATE = re.compile(r"(?:[\w.]+@[\w.]+\.com)|\b[0-9a-f]{40}\b|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|\b4[0-9]{15}\b|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", re.ASCII)


def form(value):
    if re.fullmatch("[0-9a-f]{40}", value):
        return "hexadecimal"
    if value.count(".") == 3 and value.replace(".", "").isdigit():
        return "internet"
    return re.sub("[a-z]", "a", re.sub("[0-9]", "9", value.partition("@")[0])), value.partition("@")[2]


def probability(text, lexicon):
    words = toxicity.fold(text).split()
    weight = plain_weight(words, lexicon)
    total, share = math.log1p(weight), math.log((weight + 0.05) / ((len(words) if weight else 0) + 20))
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(lexicon.curve, (1, total, share, total * share), strict=True))))


def test_stages_keep_the_columns_of_documents(spark, edge_texts, tmp_path):
    """Edge texts, a repeated row, and rows without ids, through every stage but the first two's models."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(edge_texts)] + [(11, edge_texts[11], "en", "s", 1), (None, "nameless", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, "nothing like it anywhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        n = out.count()
        if name == "encoding":
            assert n == df.count() and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
        else:
            assert out.columns == df.columns, name
            assert n == df.count() if name != "near_duplicates" else n < df.count()
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_encoding_is_decoded_again(spark):
    texts = ["", None, "a  b é 漢字 🙂", "the river " * 900]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in corpus_pipeline.encoding(spark, df, SF).collect():
        assert r.decoded == library.decode(r.ids) and r.n_tokens == len(r.ids)

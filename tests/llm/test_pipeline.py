"""The pipeline, stage by stage, against plain Python."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import common, language, secrets
from test_minhash import plain_components, plain_links
from test_operators import base_spans, texts_of


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**9, None, "en", "src0", 0), (10**9 + 1, "", None, None, None),
                                   (10**9 + 2, "12 34 !!", "en", "src1", 8)], docs.schema)
    docs = docs.unionByName(extra)
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(root / name)
        stage(spark, docs, sf).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns(staged):
    for name in ("language", "copies", "secrets", "mixture"):
        assert staged[name].dtypes == staged["input"].dtypes


def test_language_stage_keeps_clean_documents(staged):
    lost = {d for d, _ in texts_of(staged["input"])} - {d for d, _ in texts_of(staged["language"])}
    assert {10**9, 10**9 + 1, 10**9 + 2} <= lost and len(lost) <= 4


def test_copies_stage(staged):
    """Of each group of texts at a similarity of five-word sets of 0.8 or more, the smallest id stays."""
    pairs = texts_of(staged["language"])
    ids = [d for d, _ in pairs]
    component = plain_components(ids, plain_links(ids, [t for _, t in pairs]))
    assert sorted(d for d, _ in texts_of(staged["copies"])) == sorted(set(component.values()))


def test_secrets_stage(staged):
    before, after = dict(texts_of(staged["copies"])), dict(texts_of(staged["secrets"]))
    assert before.keys() == after.keys()
    for doc, text in before.items():
        assert (after[doc] == text) or "[SECRET]" in after[doc]
        assert not base_spans(after[doc])
        assert bool(base_spans(text)) <= ("[SECRET]" in after[doc])


def test_mixture_stage(staged):
    before = {r.doc_id: r for r in staged["secrets"].collect()}
    rows = staged["mixture"].collect()
    assert all(before[r.doc_id] == r for r in rows)
    assert max(collections.Counter(r.doc_id for r in rows).values()) <= 2


def test_tokens_stage(staged):
    import public_tokenizers
    import tiktoken
    ranks = common.ranks_of(common.rank_file(public_tokenizers.path(corpus_pipeline.RANK_FILE)))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((d, np.array(encoding.encode_ordinary(t), "<u4").tobytes()) for d, t in texts_of(staged["mixture"]))
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in staged["tokens"].collect()) == want


def test_run_gives_the_rows_of_the_stages(spark, sf):
    import __spark_entry__
    assert "pipeline" in __spark_entry__.queries()
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() > 100


SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, tag string, node string, key int"


def test_run_on_other_tables(spark, sf, tmp_path):
    """No rows; repeated rows and further columns with names that operators use inside."""
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    for name, docs in (("none", whole.limit(0)), ("odd", spark.createDataFrame(
            [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "t", "n", 1) for r in whole.limit(40).collect() for _ in range(2)]
            + [(None, "some text of no document at all, with words", "en", None, 3, None, None, None)], SHAPE))):
        (tmp_path / name).mkdir()
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(got) == (name == "odd")

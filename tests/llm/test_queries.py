"""The registered queries themselves, columns and formats included, against plain Python on the small tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from tablewright.llm import common, language, queries, secrets
from test_operators import RANKS, base_spans, greedy, plain_bayes, plain_components, plain_fingerprint, same_rows, texts_of


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


@pytest.fixture(scope="module")
def answer(spark, sf):
    return lambda name: queries.QUERIES[name](spark, sf)


def test_op1(rows, answer):
    vocabulary = common.ranks_of(common.rank_file(RANKS))
    got = answer("op1_token_counts")
    assert got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
    want = []
    for r in rows:
        words = (r.text or "").encode().split()
        want.append((r.doc_id, len(words), sum(greedy(b" " + w, vocabulary) for w in words), 0))
    same_rows(got.collect(), want)


def test_op2(rows, answer):
    got = answer("op2_simhash")
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    pairs = [(r.doc_id, r.text) for r in rows]
    prints = [plain_fingerprint(t) for _, t in pairs]
    same_rows(got.collect(), [(d, f"{p:016x}", c) for (d, _), p, c in zip(pairs, prints, plain_components(pairs, prints))])


def test_op3(rows, answer):
    got = answer("op3_sharding")
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = got.collect()
    same_rows([(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in found],
              [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "bytes", None) for r in rows])
    for shard in {r.shard for r in found}:
        assert 0 <= shard < 16
        own = sorted(r.slot for r in found if r.shard == shard)
        assert own == list(range(len(own)))


def test_op4(rows, answer):
    got = answer("op4_repeats")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    seen, want = {}, []
    for doc, text in sorted((r.doc_id, r.text) for r in rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen.setdefault(raw[i:i + 50], doc) < doc:
                gone[i:i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        want.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    same_rows(got.collect(), want)


def test_op5(rows, answer):
    import public_tokenizers
    import tiktoken
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=common.ranks_of(common.rank_file(RANKS)))
    got = answer("op5_byte_bpe")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in rows:
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    same_rows(got.collect(), want)


def test_op6(rows, answer):
    got = answer("op6_secrets")
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for r in rows:
        spans = base_spans(r.text or "")
        own = found[r.doc_id]
        assert (own.n_assign, own.n_access, own.n_hex) == tuple(sum(s[1] == k for s in spans) for k in secrets.BASE)
        written = [f"{kind}:{start}:{end}" for start, kind, end in spans]
        assert own.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        listed = own.spans.split(",") if own.spans else []
        assert set(written) <= set(listed) and len(listed) == len(set(listed))
        starts = [int(s.split(":")[1]) for s in listed]
        assert starts == sorted(starts) and all(len(s.split(":")) == 3 for s in listed)


def test_op7(spark, sf, answer):
    got = answer("op7_embeddings")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = np.array([r.embedding for r in table], np.float64)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    labels = np.array([-1 if r.label is None else r.label for r in table])
    near = (vectors @ vectors.T >= 0.98) & (labels[:, None] == labels) & (labels >= 0)[:, None]
    np.fill_diagonal(near, False)
    root = np.array([r.vec_id for r in table])
    for _ in table:
        least = np.where(near, root[None, :], root[:, None]).min(1)
        if (least == root).all():
            break
        root = np.minimum(root, least)
    same_rows(got.collect(), [(r.vec_id, int(near[i].sum()), int(root[i]), bool(root[i] == r.vec_id)) for i, r in enumerate(table)])


def test_op8(rows, answer):
    got = {r.doc_id: r for r in answer("op8_language").collect()}
    held = lambda doc: zlib.crc32(str(doc).encode()) % 4 == 2
    assert {d: r.held_out for d, r in got.items()} == {r.doc_id: held(r.doc_id) for r in rows}
    learn = [(r.text, r.lang) for r in rows if not held(r.doc_id) and r.text is not None and r.lang is not None]
    for r, (lang, score) in zip(rows, plain_bayes(learn, [r.text for r in rows])):
        assert got[r.doc_id].lang_pred == lang and math.isclose(got[r.doc_id].score, score, abs_tol=1e-6)
    assert answer("op8_language").columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert language.UNDETERMINED == "und"


def test_op9(rows, answer):
    got = answer("op9_mixing").collect()
    source = {r.doc_id: r.source for r in rows}
    assert got and all(source[r.doc_id] == r.source for r in got)
    assert len({(r.source, r.epoch, r.doc_id) for r in got}) == len(got)


def test_op10_columns(answer):
    assert answer("op10_quality").columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                              "base_failed", "n_removed_lines", "removed_chars", "kept"]
    assert texts_of and "op10_quality" in queries.ORACLES

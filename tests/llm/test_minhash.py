"""Near-duplicates by shingle similarity against brute force."""

import random

import pytest

import corpus_pipeline
from tablewright.llm import minhash


def plain_sets(texts):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_links(ids, texts, at_least=0.8):
    """All pairs of different rows at a similarity of ``at_least`` or more."""
    sets = plain_sets(texts)
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= at_least * len(a | b)):
                links.append((ids[j], ids[i]))
    return links


def plain_components(ids, links):
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for a, b in links:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.fixture(scope="module")
def near(spark):
    """Chains of copies with words changed one by one (similarity from 0.5 to 1), whole copies, short and empty texts."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    texts = []
    for base in range(30):
        words = [word() for _ in range(120)]
        for copy in range(8):
            changed = list(words)
            for at in draw.sample(range(120), copy if base % 2 else 2 * copy):
                changed[at] = word()
            texts.append(" ".join(changed))
    texts += [texts[0]] * 3 + ["one two three", "One  two\nthree", "one two four", "", None, " \t"]
    ids = [7 * i + 3 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    return df, ids, texts


def test_near_duplicates_by_brute_force(near):
    df, ids, texts = near
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == plain_components(ids, plain_links(ids, texts))


def test_pipeline_stage_reaches_similarity(spark, near):
    df, ids, texts = near
    left = {r.doc_id for r in corpus_pipeline.copies_stage(spark, df, "").collect()}
    assert left == set(plain_components(ids, plain_links(ids, texts)).values())


def test_blocks_do_not_change_the_result(near, monkeypatch):
    """Buckets cut into blocks: the same components."""
    df, ids, texts = near
    monkeypatch.setattr(minhash, "BLOCK", 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == plain_components(ids, plain_links(ids, texts))


def test_leaders_with_many_followers(near, monkeypatch):
    """Followers in several parts, and small blocks that are cut by shingles."""
    df, ids, texts = near
    monkeypatch.setattr(minhash, "FOLLOWERS", 2)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == plain_components(ids, plain_links(ids, texts))


def test_copies_of_one_text(spark):
    """300 copies, each with a word of its own changed: most are 0.7 alike and only the text they come from links them;
    without it, nothing does.  No step puts out their pairs."""
    draw = random.Random(9)
    words = [f"word{draw.randint(0, 10**6)}" for _ in range(64)]
    texts = []
    for i in range(300):
        own = list(words)
        own[5 + i % 54] = f"changed{i}"
        texts.append(" ".join(own))
    for rows in (texts, texts + [" ".join(words)]):
        ids = list(range(10, 10 + len(rows)))
        df = spark.createDataFrame(list(zip(ids, rows)), "doc_id bigint, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
        assert got == plain_components(ids, plain_links(ids, rows))


def test_joined_by_brute_force():
    import numpy as np
    draw = np.random.default_rng(1)
    base = [np.unique(draw.integers(0, 1000, 80)) for _ in range(6)]
    sets = [np.unique(np.r_[base[i % 6][draw.random(len(base[i % 6])) > 0.05], draw.integers(2000, 9000, 3)]).astype(np.uint64)
            for i in range(60)]
    component = np.arange(60)
    component[[0, 6, 12]] = 0
    found = minhash.joined(sets, component)
    similar = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    assert all(similar(sets[i], sets[j]) for i, j in found)
    every = [(i, j) for i in range(60) for j in range(i) if similar(sets[i], sets[j])]
    same = [(0, 6), (6, 12)]
    assert plain_components(range(60), found + same) == plain_components(range(60), every + same)
    assert len(found) < 60


def test_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    rows = [(1, long, 1, "a", 5, b"x"), (2, long + " more", None, None, None, None), (3, "a b c d e f", 2, "b", 6, b"y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id int, tag string, node int, minima binary")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert sorted(map(tuple, minhash.one_of_each(df).collect()), key=lambda r: r[0]) == [rows[0], rows[2]]


def test_ids_that_are_null_or_repeat(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(None, text), (5, text), (2, text + " more"), (2, "something else"), (9, "something else")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(False, 0, None), (True, 2, 2), (True, 2, 2), (True, 5, 2), (True, 9, 2)]
    assert sorted(r.text for r in minhash.one_of_each(df).collect()) == sorted([text, text + " more", "something else"])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.one_of_each(empty).count() == 0


def test_pipeline_stage_follows_fingerprints_too(spark):
    """Texts within four bits of op2's fingerprints are copies, also where a few words differ that five-word sets make much
    of; links of both kinds lead on."""
    draw = random.Random(4)
    word = lambda: f"w{draw.randint(0, 10**6)}"
    often = " ".join(word() for _ in range(12))
    tails = [" ".join(word() for _ in range(6)) for _ in range(2)]
    own = [f"{' '.join([often] * 80)} {tail}" for tail in tails]
    plain = [" ".join(word() for _ in range(80)) for _ in range(2)]
    rows = [(5, own[0]), (3, own[1]), (9, own[0]), (8, plain[0]), (2, plain[1]), (1, plain[0]), (None, plain[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert not [link for link in plain_links(range(2), own)]
    left = sorted((r.doc_id is None, r.doc_id) for r in corpus_pipeline.copies_stage(spark, df, "").collect())
    assert left == [(False, 1), (False, 2), (False, 3), (True, None)]

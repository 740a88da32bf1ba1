"""Spelling variants against plain Python, on all words of a table and on random vocabularies."""

import collections
import random
import re
import zlib

import pytest

from tablewright.llm import queries, spelling


def plain_vocabulary(rows, at_least=5, slip=199):
    count = collections.Counter()
    for doc, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for word in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if slip and h % slip == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= at_least}


def plain_variants(vocabulary, times=5):
    holes = collections.defaultdict(set)
    for word in vocabulary:
        for i in range(len(word)):
            holes[i, word[:i] + word[i + 1:]].add(word)
    near = {word: set() for word in vocabulary}
    for (_, rest), words in holes.items():
        for word in words:
            near[word] |= words - {word}
            if rest in vocabulary:
                near[word].add(rest)
                near[rest].add(word)
    form = {}
    for word, n in vocabulary.items():
        best = min(near[word], key=lambda x: (-vocabulary[x], x), default=None)
        form[word] = best if best is not None and vocabulary[best] >= times * n else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word
    return {w: (form[w], root(w), n, len(near[w]), vocabulary[form[w]] if form[w] is not None else None)
            for w, n in vocabulary.items()}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_spelling"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(got) == plain_variants(plain_vocabulary(rows))


def random_vocabulary(seed):
    draw = random.Random(seed)
    letters = "abç"
    vocabulary = {}
    for _ in range(700):
        word = "".join(draw.choices(letters, k=draw.randint(1, 9)))
        vocabulary[word] = draw.choice([1, 2, 3, 12, 60, 60, 300, 2000])
    long = "".join(draw.choices(letters, k=5000))
    vocabulary.update({long: 5, long[:70] + "x" + long[71:]: 50, long[1:]: 9, "é" * 300: 7, "é" * 301: 40, "日本語": 3, "日本": 90})
    return vocabulary


@pytest.mark.parametrize("tile", [spelling.CELL, 5])
def test_dense_vocabulary(spark, tile, monkeypatch):
    """Three letters: every word has many near ones, leaves hold many words; also with small tiles and frontiers."""
    monkeypatch.setattr(spelling, "CELL", tile)
    monkeypatch.setattr(spelling, "FRONTIER", 1 << 20 if tile > 5 else 50)
    monkeypatch.setattr(spelling, "LEVELS", 5 if tile > 5 else 2)
    vocabulary = random_vocabulary(4)
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n bigint")
    assert found(spelling.variants(words)) == plain_variants(vocabulary)


def test_frontiers_that_are_cut():
    import numpy as np
    draw = np.random.default_rng(2)
    vectors = draw.integers(0, 3, (200, 6))
    trie = spelling.Trie(vectors, 9)

    def leaves(shorter):
        asked = np.full(200, shorter)
        return {(int(q), int(f), int(s)) for part in trie.leaves(vectors, np.zeros(200, np.int64), asked) for q, f, s in zip(*part)}
    whole = leaves(False), leaves(True)
    spelling.FRONTIER, kept = 16, spelling.FRONTIER
    try:
        assert (leaves(False), leaves(True)) == whole
    finally:
        spelling.FRONTIER = kept
    by_leaf = {int(f): tuple(v) for f, v in zip(trie.leaf, vectors)}
    for q, v in enumerate(vectors):
        for leaf, other in by_leaf.items():
            change = sorted(a - b for a, b in zip(v, other) if a != b)
            assert ((q, leaf, spelling.DONE) in whole[1]) == (change == [1])
            if change == [-1, 1]:
                first = next(a - b for a, b in zip(v, other) if a != b)
                assert ((q, leaf, spelling.DONE) in whole[0]) == (first == 1)
            else:
                assert ((q, leaf, spelling.SAME) in whole[0]) == (not change)


def test_ties_and_chains(spark):
    vocabulary = {"abcdef": 1, "abcdeg": 8, "abcdeh": 8, "abcdehx": 40, "bbcdehx": 39, "abcdehxy": 200, "zzzzzz": 5}
    got = found(spelling.variants(spark.createDataFrame(list(vocabulary.items()), "word string, n bigint")))
    assert got == plain_variants(vocabulary)
    assert got["abcdef"][:2] == ("abcdeg", "abcdeg") and got["abcdeh"][:2] == ("abcdehx", "abcdehxy")


def test_texts_of_all_kinds(spark):
    text = "Élève ÉLÈVES naïve-naïveté  ×÷×÷×÷ 日本 Straße\U0001f600strasse" + " longword" * 5000
    rows = [(1, text, "x", 3), (1, text, "x", 3), (None, text, None, None), (2, None, "x", 1), (3, "", "x", 1), (4, " \n", "y", 2),
            (5, "a" * 30000, "z", 1), (6, text, None, 1), (7, text, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int")
    got = {r.word: r.n for r in spelling.vocabulary(df, 5, 3).collect()}
    assert got == plain_vocabulary([r[:2] for r in rows], 5, 3) and len(got) > 4
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0


def test_repeated_words_are_added_up(spark):
    words = spark.createDataFrame([("abcdef", 3), ("abcdef", 4), ("abcdefg", 35)], "word string, n bigint")
    assert found(spelling.variants(words)) == {"abcdef": ("abcdefg", "abcdefg", 7, 1, 35), "abcdefg": (None, "abcdefg", 35, 1, None)}

"""Packing: pieces against the tokenizer itself, packings against their laws and against lower bounds."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewright.llm import common, packing, queries

PATH = common.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def plain_pieces(rows, tokenizer, capacity=4096):
    out = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check_sequences(rows, capacity=4096):
    """Offsets are gapless from 0 in every sequence, none is overfull; the number of sequences."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def order(rows):
    return sorted(rows, key=str)


def test_query(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op12_packing"](spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert order(tuple(r)[:5] for r in rows) == order(plain_pieces(docs, tokenizer))
    assert check_sequences(rows) == -(-sum(r.length for r in rows) // 4096)


def test_texts_of_all_kinds(spark, tokenizer):
    texts = [None, "", " \n\t", "It's ONE'S o'clock; don't!!  x²½9٣", "Élève Straße µ ª ÿ x\u0085y", "a\x1cb\x1fc", "日本語 été é \U0001f600",
             "İSTANBUL Σίσυφος", "<|endoftext|> <|startoftext|>x", "x" * 5000, "word " * 9000, "'s't're '", "!?." * 300]
    rows = [(i, t, "en", 7, "s") for i, t in enumerate(texts)] + [(3, texts[3], None, None, None), (None, texts[4], None, 1, "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string, uid int, length string").repartition(3)
    got = packing.pack(df, PATH, capacity=64).collect()
    assert order(tuple(r)[:5] for r in got) == order(plain_pieces([r[:2] for r in rows], tokenizer, 64))
    check_sequences(got, 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


@pytest.mark.parametrize("kind", ["tiny", "mixed", "halves", "thirds"])
def test_levels_and_islands(spark, kind, monkeypatch):
    """Many small cells over several levels: sequences near the lower bound."""
    monkeypatch.setattr(packing, "CELL", 128)
    monkeypatch.setattr(packing, "CELL_SEQUENCES", 4)
    draw = np.random.default_rng(3)
    lengths = {"tiny": np.ones(3000, int), "mixed": draw.integers(1, 101, 1500), "halves": draw.integers(51, 100, 900),
               "thirds": draw.integers(20, 50, 1000)}[kind]
    items = spark.createDataFrame([(10 * i, int(n)) for i, n in enumerate(lengths)], "uid bigint, length bigint").repartition(4)
    got = packing.assign(items, 100).join(items, "uid").collect()
    assert sorted(r.uid for r in got) == [10 * i for i in range(len(lengths))]
    room = []  # best fit of all items, largest first, by trying every sequence
    for size in sorted(map(int, lengths), reverse=True):
        fitting = [k for k, r in enumerate(room) if r >= size]
        k = min(fitting, key=room.__getitem__, default=len(room))
        if k == len(room):
            room.append(100)
        room[k] -= size
    assert check_sequences(got, 100) <= 1.03 * len(room) + 1


def test_genetic_steps_keep_every_piece():
    draw = np.random.default_rng(5)
    lengths = draw.integers(1, 60, 300)
    packings = packing.Packings(lengths, 100, [1])
    population = packings.first()
    start = packings.score(population[0])
    for child in (packings.cross(population[0], population[-1]), packings.mutate(population[0])):
        fill = packings.fill(child)
        assert fill.max() <= 100 and fill.min() > 0 and fill.sum() == lengths.sum()
    best = packings.evolve(population)[0]
    assert packings.score(best) >= start


def test_crossover_brings_whole_sequences():
    lengths = np.array([60, 40, 70, 30, 50, 50])
    packings = packing.Packings(lengths, 100, [2])
    father = np.array([0, 0, 1, 1, 2, 2])
    child = packings.cross(np.array([0, 1, 2, 3, 4, 5]), father)
    together = [(0, 1), (2, 3), (4, 5)]
    assert any(child[a] == child[b] for a, b in together) and packings.fill(child).max() <= 100
    assert len(packings.fill(packings.evolve([child])[0])) == 3

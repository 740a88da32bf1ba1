"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token ids with an end mark; only those longer than a sequence are cut.  Pieces that are not full
are dealt into cells of a few thousand.  Each cell is packed by several islands: populations whose individuals are whole
packings.  A crossover injects well-filled sequences of one parent as a whole into the other, removes the sequences that
hold the same pieces, and puts what they held besides by best fit, largest first.  After every epoch an island sends its
elite to the next one.  Fitness counts sequences first and rewards unequal filling second, so slack gathers in few
sequences.  Those with the most slack of every cell are opened again and packed together, cell by cell, on the next level,
until one cell is left: what all cells waste meets there.

Cells, islands and levels are rows of stored tables, so nothing passes whole through one task or the driver; a cell holds
about 4,096 pieces, or as many tiny ones as fill 64 sequences.

Edge cases: a null or empty text is its end mark alone; null ids stay null; repeated rows are documents of their own;
an empty table gives an empty table; other columns are ignored.  The number of tokens of a sequence is at least 1.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

CELL = 4096          # pieces of a cell
CELL_SEQUENCES = 64  # that tiny pieces of a cell fill at least
ISLANDS, EPOCHS = 3, 2
POPULATION, OFFSPRING = 6, 24
REOPENED = 16        # one piece of so many goes on to the next level, about
LEVELS = 12
CACHED_SPANS = 800_000
LONG_SPAN = 64  # longer ones are not kept

# What the tokenizer's pattern finds in lower-cased text of code points below 256.
SIMPLE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]"
                    "|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space to Python only


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level models spell bytes: printable ones of the first 256 stand for themselves, the others
    for the next code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + n) for n, b in enumerate(rest)}


class SpanIds(dict):
    """Ids of the spans between white space in a text, kept as they come up.  No match of the pattern crosses white space."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, span: str) -> bytes:
        words = SIMPLE.findall(span)
        ids = self._spell(span) if len(words) == 1 else b"".join(map(self.__getitem__, words))
        if len(span) <= LONG_SPAN:  # spans of any length come only once
            self[span] = ids
        return ids

    def _spell(self, word: str) -> bytes:
        """The ids of one match of the pattern."""
        spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)


class WordCache:
    """Ids of whole texts by a tokenizer that drops white space.  Texts with other characters than the first 256 go
    through the tokenizer as they are."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        self.known = SpanIds(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        if len(self.known) > CACHED_SPANS:
            self.known.clear()
        find, out = self.known.__getitem__, []
        for text in texts:
            try:
                text.encode("latin-1")
                simple = not any(c in text for c in SEPARATORS)
            except UnicodeEncodeError:
                simple = False
            if simple:
                out.append(b"".join(map(find, text.lower().split())))
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, "<u4").tobytes())
        return out


@lru_cache(maxsize=2)
def _cache(content: str) -> WordCache:
    return WordCache(content)


def _cut(content: str, capacity: int, end_id: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(content)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in common.pieces([whole], 1):
                rows, piece, length, crc = [], [], [], []
                for row, ids in enumerate(cache.encode([text or "" for text in batch.column(1).to_pylist()])):
                    ids = memoryview(ids + end)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append(row)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"])
    return each


def cut(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id",
        text_column: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document: its ids and ``end_id``, in pieces of ``capacity``."""
    with open(tokenizer_path, encoding="utf-8") as source:
        content = source.read()  # of fixed size, a few megabytes
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text")).mapInArrow(
        _cut(content, capacity, end_id), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ------------------------------------------------------------------ one population

class Packings:
    """Packings of one cell.  An individual is the number of the sequence of each piece; sequences are numbered from 0."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: list[int]):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.sizes = self.lengths.tolist()
        self.draw = np.random.default_rng(seed)
        self.fewest = -(-int(self.lengths.sum()) // capacity)

    def fill(self, sequence: np.ndarray) -> np.ndarray:
        return np.bincount(sequence, weights=self.lengths).astype(np.int64)

    def score(self, sequence: np.ndarray) -> float:
        """Fewer sequences first; among as many, the more unequal filling."""
        fill = self.fill(sequence) / self.capacity
        return -len(fill) + float((fill * fill).sum()) / len(fill)

    def perfect(self, sequence: np.ndarray) -> bool:
        """No packing has fewer sequences, nor its slack in fewer of them."""
        fill = self.fill(sequence)
        return len(fill) == self.fewest and int((fill < self.capacity).sum()) <= 1

    def place(self, pieces: np.ndarray, sequence: np.ndarray, room: list[int]) -> np.ndarray:
        """Put pieces into the fullest sequence that has room for each, in the order given, or into new ones."""
        by_room: dict[int, list[int]] = {}
        mask = 0
        for k, r in enumerate(room):
            if r:
                by_room.setdefault(r, []).append(k)
                mask |= 1 << r
        for i in pieces.tolist():
            size = self.sizes[i]
            if fitting := mask >> size:
                r = size + (fitting & -fitting).bit_length() - 1
                k = by_room[r].pop()
                if not by_room[r]:
                    mask &= ~(1 << r)
            else:
                k, r = len(room), self.capacity
                room.append(r)
            room[k] = r = r - size
            if r:
                by_room.setdefault(r, []).append(k)
                mask |= 1 << r
            sequence[i] = k
        return sequence

    def falling(self, pieces: np.ndarray) -> np.ndarray:
        return pieces[np.argsort(-self.lengths[pieces], kind="stable")]

    def first(self) -> list[np.ndarray]:
        """Best fit, largest first, and the same with sizes blurred more and more."""
        every = np.arange(len(self.lengths))
        out = []
        for k in range(POPULATION):
            blurred = self.lengths * self.draw.uniform(1 - 0.1 * k, 1, len(every))
            order = every[np.argsort(-blurred, kind="stable")]
            out.append(self.place(order, np.empty(len(every), np.int64), []))
            if self.perfect(out[-1]):
                break
        return out

    def _rebuilt(self, sequence: np.ndarray, kept: np.ndarray, injected: np.ndarray | None = None) -> np.ndarray:
        """Keep the sequences ``kept`` of ``sequence``, and those of ``injected`` (-1: none); place the rest by best fit."""
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        out = number[sequence]
        if injected is not None:
            inside = injected >= 0
            out[inside] = int(kept.sum()) + np.unique(injected[inside], return_inverse=True)[1]
        open_ = np.flatnonzero(out < 0)
        placed = out >= 0
        room = (self.capacity - np.bincount(out[placed], weights=self.lengths[placed])).astype(np.int64).tolist()
        return self.place(self.falling(open_), out, room)

    def cross(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """Some well-filled sequences of the father, whole, into the mother."""
        fill = self.fill(father)
        good = np.flatnonzero(fill >= np.median(fill))
        chosen = np.zeros(len(fill), bool)
        chosen[self.draw.choice(good, max(1, len(good) // 3), replace=False)] = True
        injected = np.where(chosen[father], father, -1)
        kept = np.ones(int(mother.max()) + 1, bool)
        kept[mother[injected >= 0]] = False  # these hold pieces that come with the father's
        return self._rebuilt(mother, kept, injected)

    def mutate(self, sequence: np.ndarray) -> np.ndarray:
        """Open the emptiest sequence and some others that are not full."""
        fill = self.fill(sequence)
        open_ = np.flatnonzero(fill < self.capacity)
        if not len(open_):
            return sequence
        kept = np.ones(len(fill), bool)
        kept[fill.argmin()] = False
        kept[self.draw.choice(open_, max(1, len(open_) // 8), replace=False)] = False
        return self._rebuilt(sequence, kept)

    def evolve(self, population: list[np.ndarray], offspring: int = OFFSPRING) -> list[np.ndarray]:
        """The population after ``offspring`` births, best first.  A child takes the place of the worst it beats."""
        ranked = sorted(((self.score(p), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
        for birth in range(offspring):
            if self.perfect(ranked[0][2]):
                break
            mother, father = (ranked[min(self.draw.integers(0, len(ranked), 2))][2] for _ in range(2))
            child = self.mutate(mother) if mother is father or birth % 3 == 2 else self.cross(mother, father)
            score = self.score(child)
            if len(ranked) < POPULATION or score > ranked[-1][0] and all(score != s for s, _, _ in ranked):
                ranked = sorted([*ranked, (score, len(population) + birth, child)], key=lambda x: (-x[0], x[1]))[:POPULATION]
        return [p for _, _, p in ranked]


# ------------------------------------------------------------------ islands

STATE = "cell bigint, island int, lengths array<bigint>, population array<binary>, elite binary, score double"


def _epoch(capacity: int, level: int, epoch: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = lambda many: [np.frombuffer(one, "<i4").astype(np.int64) for one in many]
        for batch in batches:
            for cell, island, lengths, population, guests in zip(*(batch.column(k).to_pylist() for k in range(5))):
                packings = Packings(np.array(lengths), capacity, [level, epoch, cell, island])
                own = unpacked(population or []) + unpacked(guests or [])
                best = packings.evolve(own or packings.first())
                packed = [p.astype("<i4").tobytes() for p in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell]), pa.array([island], pa.int32()), pa.array([lengths], pa.list_(pa.int64())),
                     pa.array([packed], pa.list_(pa.binary())), pa.array([packed[0]], pa.binary()),
                     pa.array([packings.score(best[0])])],
                    ["cell", "island", "lengths", "population", "elite", "score"])
    return each


def _closed(capacity: int, last: bool):
    """(uid, length, sequence_id, offset) of a cell's best packing; what is to be packed again has no sequence."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items, elite in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                uid = np.array([item["uid"] for item in items], np.int64)
                length = np.array([item["length"] for item in items], np.int64)
                sequence = np.frombuffer(elite, "<i4").astype(np.int64)
                fill = np.bincount(sequence, weights=length).astype(np.int64)
                held = np.bincount(sequence)
                open_ = np.zeros(len(fill), bool)
                if not last:
                    slack = np.flatnonzero(fill < capacity)
                    slack = slack[np.argsort(fill[slack], kind="stable")]
                    many = np.cumsum(held[slack]) <= max(64, len(uid) // REOPENED)
                    open_[slack[many]] = True
                    open_[slack[:1]] = True
                order = np.lexsort((uid, sequence))
                uid, length, sequence = uid[order], length[order], sequence[order]
                start = np.cumsum(held) - held
                ends = np.cumsum(length)
                offset = ends - length - (ends - length)[start][sequence]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), pa.array(length), pa.array(uid[start][sequence], mask=open_[sequence]), pa.array(offset)],
                    ["uid", "length", "sequence_id", "offset"])
    return each


def assign(items: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid long, unique; length long, 1 to ``capacity``)."""
    full = items.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"),
                                                           F.lit(0).cast("bigint").alias("offset"))
    parts, rest = [full], items.where(F.col("length") < capacity).select("uid", "length")
    for level in range(LEVELS + 1):
        count, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not count:
            break
        cells = max(1, min(count // CELL, tokens // (CELL_SEQUENCES * capacity)))
        last = cells == 1 or level == LEVELS
        dealt = common.stored(
            rest.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(cells)).cast("bigint").alias("cell"))
            .agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items")), "cells")
        state = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                             F.col("items.length").alias("lengths"),
                             F.lit(None).cast("array<binary>").alias("population"),
                             F.lit(None).cast("array<binary>").alias("guests"))
        for epoch in range(epochs):
            if epoch:  # the elite of each island visits the next one
                guests = state.select(F.col("cell").alias("c"), F.pmod(F.col("island") + 1, F.lit(islands)).alias("i"),
                                      F.array("elite").alias("guests"))
                state = state.join(guests, (F.col("cell") == F.col("c")) & (F.col("island") == F.col("i"))).select(
                    "cell", "island", "lengths", "population", "guests")
            spread = state.repartition(F.col("cell"), F.col("island"))
            state = common.stored(spread.mapInArrow(_epoch(capacity, level, epoch), STATE), "islands")
        best = state.groupBy(F.col("cell").alias("c")).agg(F.max_by("elite", F.struct("score", -F.col("island"))).alias("elite"))
        told = common.stored(
            dealt.join(best, F.col("cell") == F.col("c")).select("items", "elite").mapInArrow(
                _closed(capacity, last), "uid bigint, length bigint, sequence_id bigint, offset bigint"), "packed")
        parts.append(told.where("sequence_id is not null").select("uid", "sequence_id", "offset"))
        if last:
            break
        rest = told.where("sequence_id is null").select("uid", "length")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """``id_column``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of every piece."""
    own = common.stored(cut(df, tokenizer_path, capacity, end_id, id_column, text_column).withColumn(
        "uid", F.monotonically_increasing_id()), "pieces")
    placed = assign(own.select("uid", "length"), capacity).withColumnRenamed("uid", "u")
    return own.join(placed, F.col("uid") == F.col("u")).select(
        F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

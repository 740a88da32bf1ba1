"""Byte-level BPE: pre-tokenisation by a scanned automaton, cached pair merging, and decoding.

The pre-tokenisation pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is run without a regular expression.  Every code point becomes one of ten symbols (its class, and what the next one or
two code points are where the pattern looks ahead).  Each symbol is a function on eight states.  Composition of such
functions is associative, so texts are cut into blocks, the functions of all blocks are composed side by side, a scan
over the block functions gives every block its entry state, and one more sweep yields the boundaries.

Edge cases: null text counts as empty (no tokens); a null id stays null; repeated rows and ties give equal rows; empty
tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm import common

# Symbols.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, SPACE_LAST, BLANK, BLANK_LAST, BREAK = range(10)
# States: between tokens; in a run of letters, numbers, others, white space; after a leading blank; in a contraction
# with one or two letters to come.
FRESH, IN_L, IN_N, IN_O, IN_S, LEAD, ONE, TWO = range(8)
STATES = 8
BLOCK = 128
CACHED_PIECES = 400_000
# The code points of \s.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a token starts here' for (symbol, state)."""
    after = np.zeros((10, STATES), np.uint8)
    starts = np.ones((10, STATES), bool)
    for symbol, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (SPACE, IN_S), (BLANK, IN_S)):
        after[symbol] = run
        starts[symbol, run] = False
    for symbol in (LETTER, NUMBER, OTHER, SHORT, LONG):
        starts[symbol, LEAD] = False
    after[LETTER, ONE], after[LETTER, TWO] = FRESH, ONE
    starts[LETTER, [ONE, TWO]] = False
    for symbol, rest in ((SHORT, ONE), (LONG, TWO)):
        after[symbol] = rest
        after[symbol, [IN_O, LEAD]] = IN_O
        starts[symbol, IN_O] = False
    after[SPACE_LAST], after[BLANK_LAST], after[BREAK] = FRESH, LEAD, FRESH
    return after, starts


AFTER, STARTS = _automaton()


def _monoid() -> tuple[np.ndarray, np.ndarray]:
    """All functions that the symbols generate, the symbols' own first: their products and their values at FRESH."""
    found = [tuple(f) for f in AFTER.tolist()] + [tuple(range(STATES))]
    known = {f: i for i, f in reversed(list(enumerate(found)))}
    for f in found:
        for g in found[:len(AFTER)]:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(found)
                found.append(h)
    product = np.array([[known[tuple(g[s] for s in f)] for g in found] for f in found], np.intp)
    return product, np.array([f[FRESH] for f in found], np.intp)


PRODUCT, AT_FRESH = _monoid()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[list(WHITE)] = SPACE
    return table


def symbols(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The symbol of every code point; ``breaks`` are the places of separators between texts."""
    kinds = _classes()[codes]
    kinds[breaks] = BREAK
    out = kinds.copy()
    follows_text = np.zeros(len(kinds), bool)  # the next code point exists and is no white space
    follows_text[:-1] = (kinds[1:] != SPACE) & (kinds[1:] != BREAK)
    white = kinds == SPACE
    blank = white & (codes == 32)
    out[white & follows_text] = SPACE_LAST
    out[blank] = BLANK
    out[blank & follows_text] = BLANK_LAST
    marks = np.flatnonzero((codes[:-1] == 39) & (kinds[:-1] == OTHER))
    first = codes[marks + 1]
    second = codes[np.minimum(marks + 2, len(codes) - 1)]
    second[marks + 2 >= len(codes)] = 0
    out[marks[np.isin(first, [ord(c) for c in "stmd"])]] = SHORT
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    out[marks[two]] = LONG
    return out


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """True where a token starts: blocked scan over transition functions."""
    n, width = len(symbol), len(PRODUCT)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, BREAK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    product, after, starts = PRODUCT.ravel(), AFTER.ravel().astype(np.intp), STARTS.ravel()
    whole = columns[0].astype(np.intp)
    for column in columns[1:]:
        whole = product.take(whole * width + column)
    step = 1
    while step < blocks:  # inclusive scan over the functions of the blocks
        whole[step:] = product.take(whole[:-step] * width + whole[step:])
        step *= 2
    state = np.full(blocks, FRESH, np.intp)
    state[1:] = AT_FRESH[whole[:-1]]
    found = np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(columns):
        at = column.astype(np.intp) * STATES + state
        found[j] = starts.take(at)
        state = after.take(at)
    return found.T.ravel()[:n]


def split(texts: list[str]) -> tuple[list[bytes], list[int]]:
    """The pieces of all texts, each text followed by one piece for its end, and the number of the first piece of every
    text and one past the last."""
    joined = "\0".join(texts) + "\0"
    raw = np.frombuffer(joined.encode(), np.uint8)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.flatnonzero(token_starts(symbols(codes, breaks)))
    places = starts if len(raw) == len(codes) else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
    # Byte 255 never occurs in UTF-8: put one before every piece and cut there.
    marked = np.full(len(raw) + len(places), 255, np.uint8)
    marks = np.zeros(len(marked), bool)
    marks[places + np.arange(len(places))] = True
    marked[~marks] = raw
    return marked.tobytes().split(b"\xff")[1:], [0, *(np.searchsorted(starts, breaks) + 1).tolist()]


class Merger(dict):
    """Pieces to their ids (little-endian, four bytes each).  Pieces that are new to the cache are merged together."""

    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted({(ranks[token[:k]] << 20 | ranks[token[k:]], rank) for token, rank in ranks.items()
                        for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks})
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.joined = np.array([r for _, r in pairs], np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Make sure that all pieces are in the cache."""
        new = set(pieces).difference(self)
        if len(self) + len(new) > CACHED_PIECES:
            self.clear()
            new = set(pieces)
        short = []
        for piece in new:
            if piece in self.ranks:
                self[piece] = self.ranks[piece].to_bytes(4, "little")
            elif len(piece) <= 64:
                short.append(piece)
            else:
                self[piece] = np.array(self.merged(piece), "<u4").tobytes()
        for i in range(0, len(short), 1 << 14):  # at most 2**20 bytes at once: merged_together packs places in 20 bits
            self.update(zip(short[i:i + (1 << 14)], self.merged_together(short[i:i + (1 << 14)])))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], self.NONE)

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """Each round joins, in every piece that has one, the leftmost pair of lowest rank."""
        token = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(token), self.NONE)
        inner = np.flatnonzero(own[:-1] == own[1:])
        rank[inner] = self.rank(token[inner], token[inner + 1])
        done: list[bytes] = [b""] * len(pieces)
        while len(token):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.minimum.reduceat(rank << 20 | np.arange(len(rank)), first)
            open_ = best >> 20 < self.NONE
            if not open_.all():
                last = np.r_[first[1:], len(own)]
                packed = token.astype("<u4").tobytes()
                for i, a, b in zip(own[first[~open_]].tolist(), first[~open_].tolist(), last[~open_].tolist()):
                    done[i] = packed[4 * a:4 * b]
            at = best[open_] & 0xFFFFF
            token[at] = rank[at]
            keep = np.repeat(open_, np.diff(np.r_[first, len(own)]))
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            token, own, rank, at = token[keep], own[keep], rank[keep], place[at]
            for left in (at - 1, at):
                fits = left[(left >= 0) & (left + 1 < len(token))]
                same = own[fits] == own[fits + 1]
                rank[fits] = self.NONE
                fits = fits[same]
                rank[fits] = self.rank(token[fits], token[fits + 1])
            if len(rank):
                rank[-1] = self.NONE
        return done

    def merged(self, piece: bytes) -> list[int]:
        """The same for one long piece, in n log n steps by a heap."""
        ranks = self.ranks
        n = len(piece)
        end = list(range(1, n + 1))       # where the part that starts here ends; 0: it is part of another
        before = list(range(-1, n - 1))
        heap = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle <= 0 or middle >= n or end[middle] != stop:
                continue  # one of the two parts has been merged since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (rank, left, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:end[i]]])
            i = end[i]
        return ids


@lru_cache(maxsize=2)
def _merger(content: bytes) -> Merger:
    return Merger(common.ranks_of(content))


@lru_cache(maxsize=2)
def _vocabulary(content: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in common.ranks_of(content).items()}


def encode_texts(texts: list[str], merger: Merger) -> list[bytes]:
    """The packed ids of each text."""
    found, firsts = split(texts)
    merger.learn(found)
    return [b"".join(map(merger.__getitem__, found[a:b - 1])) for a, b in zip(firsts, firsts[1:])]


def decode_ids(packed: bytes, vocabulary: dict[int, bytes]) -> bytes:
    return b"".join(map(vocabulary.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def token_ends(packed: bytes, vocabulary: dict[int, bytes]) -> bytes:
    """Where each token ends in the text's bytes, so that any range of ids can be decoded in place."""
    sizes = [len(vocabulary[i]) for i in np.frombuffer(packed, "<u4").tolist()]
    return np.cumsum(sizes, dtype="<u4").tobytes()


def _each(batches: Iterator[pa.RecordBatch], content: bytes, decoded: bool, ends: bool) -> Iterator[pa.RecordBatch]:
    merger, vocabulary = _merger(content), _vocabulary(content)
    for piece in common.pieces(batches, 1, 1 << 19):
        ids = encode_texts([t or "" for t in piece.column(1).to_pylist()], merger)
        columns = [piece.column(0), pa.array(ids, pa.binary())]
        names = ["id", "ids"]
        if decoded:
            columns.append(pa.array([decode_ids(x, vocabulary) for x in ids], pa.binary()))
            names.append("decoded")
        if ends:
            columns.append(pa.array([token_ends(x, vocabulary) for x in ids], pa.binary()))
            names.append("token_ends")
        yield pa.RecordBatch.from_arrays(columns, names)


def encode(df: DataFrame, rank_path: str, id_column: str = "doc_id", text_column: str = "text",
           decoded: bool = False, ends: bool = False) -> DataFrame:
    """One row per input row: ``id_column``, ``ids`` (little-endian unsigned 32-bit integers), on demand ``decoded``
    (the bytes that the ids stand for) and ``token_ends`` (byte offsets)."""
    content = common.rank_file(rank_path)
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, ids binary" + ", decoded binary" * decoded + ", token_ends binary" * ends
    return (df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
            .mapInArrow(lambda batches: _each(batches, content, decoded, ends), schema)
            .withColumnRenamed("id", id_column))


def decode(df: DataFrame, rank_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per input row: ``id_column`` and ``decoded``; null ids decode to null."""
    content = common.rank_file(rank_path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        for piece in common.pieces(batches, 1):
            texts = [None if x is None else decode_ids(x, vocabulary) for x in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.binary())], ["id", "decoded"])

    kind = df.schema[id_column].dataType.simpleString()
    return (df.select(df[id_column].alias("id"), df[ids_column].alias("ids"))
            .mapInArrow(each, f"id {kind}, decoded binary").withColumnRenamed("id", id_column))

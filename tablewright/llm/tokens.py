"""Token counts: how many greedy longest-match pieces each text's words have, without building the pieces.

A vocabulary becomes a trie.  A node v carries a failure link and the number of pieces that are settled when it is
followed: if no child of v fits the next byte, the longest pieces of what v spells are popped, and the link names the
node that spells the rest.  Both are precomputed, so a word of n bytes takes O(n) steps whatever the vocabulary, also
where a plain greedy search would go back again and again.

Words are runs of bytes other than space and 9 to 13.  A word for which no sequence of pieces exists counts as one
token and as one unknown word.  Edge cases: null and empty texts have no words and no tokens; a null id stays null;
repeated rows give equal rows; empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm import common

UNKNOWN = -1
CACHED_WORDS = 500_000


class Automaton:
    """Greedy longest match over ``start`` pieces at the beginning of a word and ``inner`` pieces after it."""

    def __init__(self, start: Iterable[bytes], inner: Iterable[bytes] | None = None):
        self.child: dict[int, int] = {}  # node << 8 | byte to node
        self.piece = [False]
        self.link: list[int] = []
        self.popped: list[int] = []
        self.root = self._grow(0, start)
        if inner is None:
            self.suffix = self.root
        else:
            self.piece.append(False)
            self.suffix = self._grow(len(self.piece) - 1, inner)
        self._link()

    def _grow(self, root: int, pieces: Iterable[bytes]) -> int:
        child, ends = self.child, self.piece
        for piece in pieces:
            node = root
            for byte in piece:
                key = node << 8 | byte
                if (following := child.get(key)) is None:
                    following = child[key] = len(ends)
                    ends.append(False)
                node = following
            if piece:
                ends[node] = True
        return root

    def _link(self) -> None:
        """Failure links and popped counts.  They depend on nodes that spell less, so nodes are taken by depth."""
        child, link, popped = self.child, [-1] * len(self.piece), [0] * len(self.piece)
        depth = [0] * len(self.piece)
        for key, node in child.items():  # parents are older than their children
            depth[node] = depth[key >> 8] + 1
        for key, node in sorted(child.items(), key=lambda item: depth[item[1]]):
            if self.piece[node]:
                link[node], popped[node] = self.suffix, 1
                continue
            at, count = link[key >> 8], popped[key >> 8]
            byte = key & 255
            while at >= 0 and (following := child.get(at << 8 | byte)) is None:
                count += popped[at]
                at = link[at]
            if at >= 0:
                link[node], popped[node] = following, count
        self.link, self.popped = link, popped

    def count(self, word: bytes) -> int:
        """The number of pieces, or UNKNOWN."""
        child, link, popped = self.child, self.link, self.popped
        at, total = self.root, 0
        for byte in word:
            while (following := child.get(at << 8 | byte)) is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return UNKNOWN
            at = following
        while at != self.suffix:
            total += popped[at]
            at = link[at]
            if at < 0:
                return UNKNOWN
        return total


@lru_cache(maxsize=2)
def _from_ranks(content: bytes) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(common.ranks_of(content)), {}


def _counts(batches: Iterator[pa.RecordBatch], content: bytes) -> Iterator[pa.RecordBatch]:
    automaton, known = _from_ranks(content)
    for piece in common.pieces(batches, 1):
        words = [(text or "").encode().split() for text in piece.column(1).to_pylist()]
        new = {word for own in words for word in own}.difference(known)
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = {word for own in words for word in own}
        for word in new:
            known[word] = automaton.count(b" " + word)
        if max(map(len, new), default=0) > 64:
            long = [word for word in new if len(word) > 64]
        else:
            long = []
        found = [np.fromiter(map(known.__getitem__, own), np.int64, len(own)) for own in words]
        for word in long:
            del known[word]
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array([len(f) for f in found], pa.int64()),
             pa.array([int(np.abs(f).sum()) for f in found], pa.int64()),
             pa.array([int((f == UNKNOWN).sum()) for f in found], pa.int64())],
            ["id", "n_words", "n_tokens", "n_unknown"])


def count_tokens(df: DataFrame, rank_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_words``, ``n_tokens``, ``n_unknown`` for every row, by the tokens of a rank file.  A token
    that begins with a space begins a word; every word is read with a space before it."""
    content = common.rank_file(rank_path)
    kind = df.schema[id_column].dataType.simpleString()
    return (df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
            .mapInArrow(lambda batches: _counts(batches, content),
                        f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
            .withColumnRenamed("id", id_column))

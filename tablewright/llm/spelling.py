"""Spelling variants: words of a vocabulary that differ by one letter, and the more frequent form each stands for.

Letters fall into groups, and a word's vector says how many letters of each group it has.  One inserted, deleted or
replaced letter changes the vector by one surplus and one deficit at most.  Words are arranged in a trie by their length
and then by the counts of one group after the other; a search goes down with the budget of one surplus and one deficit, and
verifies the words of the leaves that it reaches.  A word looks for equally long ones (a surplus first, then a deficit,
so each pair meets from one side) and for those that are a letter shorter (one surplus, no deficit).

The upper levels of the trie are shuffle keys: every word lives in the cell of its first counts, and is sent as a query to
the cells within its budget.  How many levels that takes follows the size of the vocabulary; a cell that is still large is
cut into tiles of words and queries.  In a task, all queries of a block go down level by level as arrays; large
frontiers are cut in two and taken depth first, so memory is bounded.  Inside a leaf, words are looked up by their first and
by their second half, one of which a near word shares; so leaves with many words are never compared in full.  Tasks
put out what a word has gained (number, best), never pairs.

Edge cases: null and empty texts have no words; a null id counts as the empty text in the digest that slips letters; repeated rows count
each.  Ties of the most frequent near word go to the smallest in code-point order.  Vocabularies hold no null, and every word
once (``near_words`` takes the sum if one repeats).  Words may be of any length.  Empty tables give empty tables;
further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

GROUPS = 11
CELL = 20_000       # words of a tile
ALIKE = 4_000       # words that the counts above a cell leave alike, about
LEVELS = 5          # of the trie above a cell, at least
QUERIES = 4096      # of one descent
FRONTIER = 1 << 20  # larger ones are cut in two
HELD = 400_000      # distinct words that a task counts before it passes them on
HOME = 3            # in the place of a state: the word lives here
SAME, OWES, DONE = 0, 1, 2  # states: no difference yet; a surplus that a deficit must follow; all spent

# Letters keep their code (A to Z as a to z), anything else becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counted(slip: int):
    """(word, n) of a task: runs of letters by document, one letter of every ``slip``-th deleted."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                              pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for whole in batches:
            for batch in common.pieces([whole], 1):
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    begin = zlib.crc32(f"{'' if key is None else key}:".encode())
                    own = Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split())
                    for word, n in own.items():
                        if len(word) < 6:
                            continue
                        if slip:
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begin)
                            if h % slip == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                                if len(word) < 6:
                                    continue
                        held[word] += n
                    if len(held) >= HELD:
                        yield rows()
        if held:
            yield rows()
    return each


def vocabulary(df: DataFrame, at_least: int = 5, slip: int = 0, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """(word, n): words of at least six code points ``[A-Za-z\\u00C0-\\u00FF]`` (A to Z in lower case) that occur
    ``at_least`` times.  With ``slip``, a document's word loses one letter where that number divides the CRC-32 of
    ``id:word``."""
    rows = df.select(df[id_column].cast("string").alias("id"), df[text_column].cast("string").alias("text"))
    return (rows.mapInArrow(_counted(slip), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= at_least))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), len(words[0]))


def _vectors(codes: np.ndarray) -> np.ndarray:
    group = (codes % GROUPS).astype(np.int64) + np.arange(len(codes))[:, None] * GROUPS
    return np.bincount(group.ravel(), minlength=len(codes) * GROUPS).reshape(-1, GROUPS)


def _reach(counts: np.ndarray):
    """(query, state, vector of the cell, whether a letter is shorter) of all cells within the budget."""
    every = np.arange(len(counts))
    yield every, SAME, counts, False
    yield every, SAME, counts, True
    depth = counts.shape[1]
    for i in range(depth):
        able = np.flatnonzero(counts[:, i] > 0)
        less = counts[able].copy()
        less[:, i] -= 1
        yield able, DONE, less, True
        yield able, OWES, less, False
        for j in range(i + 1, depth):
            more = less.copy()
            more[:, j] += 1
            yield able, DONE, more, False


def _dealt(depth: int):
    """Each word at home in its cell, and as a query to the cells in reach."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            words = np.array(whole.column(0).to_pylist(), object)
            n = whole.column(1).to_numpy()
            sizes = np.array([len(w) for w in words], np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for start in range(0, len(own), 2048):
                    at = own[start:start + 2048]
                    counts = _vectors(_codes(list(words[at])))[:, :depth]
                    sent = [(np.arange(len(at)), HOME, counts, False), *_reach(counts)]
                    for rows, state, cells, shorter in sent:
                        name = np.column_stack([np.full(len(rows), size - shorter), cells]).astype("<i4")
                        names = pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(name.shape[1] * 4), len(rows), [None, pa.py_buffer(name.tobytes())])
                        yield pa.RecordBatch.from_arrays(
                            [names.cast(pa.binary()), pa.array(np.full(len(rows), state, np.int8)),
                             pa.array(list(words[at[rows]]), pa.string()), pa.array(n[at[rows]])],
                            ["cell", "state", "word", "n"])
    return each


class Trie:
    """Vectors by successive counts: the children of a level are sorted keys (node, count)."""

    def __init__(self, vectors: np.ndarray, base: int):
        self.base, self.keys = base, []
        node = np.zeros(len(vectors), np.int64)
        for level in range(vectors.shape[1]):
            keys, node = np.unique(node * base + vectors[:, level], return_inverse=True)
            self.keys.append(keys)
        self.leaf = node

    def leaves(self, vectors: np.ndarray, states: np.ndarray, shorter: np.ndarray) -> Iterator[tuple]:
        """(query, leaf, state) of all leaves within the budget."""
        stack = [(0, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), states)]
        while stack:
            level, query, node, state = stack.pop()
            if level == len(self.keys):
                fine = (state == DONE) | (state == SAME) & ~shorter[query]
                yield query[fine], node[fine], state[fine]
                continue
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(level, query[k], node[k], state[k]) for k in (slice(half, None), slice(half))]
                continue
            count = vectors[query, level]
            after = np.where(shorter[query], DONE, OWES)
            steps = [(np.ones(len(query), bool), 0, state), ((state == SAME) & (count > 0), -1, after),
                     (state == OWES, 1, np.full(len(query), DONE))]
            next_ = []
            for able, change, then in steps:
                able = np.flatnonzero(able)
                key = node[able] * self.base + count[able] + change
                place = np.searchsorted(self.keys[level], key)
                there = place < len(self.keys[level])
                there[there] = self.keys[level][place[there]] == key[there]
                next_.append((query[able[there]], place[there], then[able[there]]))
            stack.append((level + 1, *map(np.concatenate, zip(*next_))))


def _halves(codes: np.ndarray, first: int, second: int) -> list[np.ndarray]:
    """Digests of the first letters and of those from ``second`` on (64 bits; words are verified later)."""
    out = []
    for part in (codes[:, :first], codes[:, second:]):
        h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
        for letter in part.T.astype(np.uint64):
            h = (h ^ letter) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        out.append(h)
    return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which place, for every place of all ranges."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]


def _near(depth: int):
    def each(table: pa.Table) -> pa.Table:
        state = table.column("state").to_numpy()
        words = np.array(table.column("word").to_pylist(), object)
        n = table.column("n").to_numpy()
        home, asked = np.flatnonzero(state == HOME), np.flatnonzero(state != HOME)
        if not len(home) or not len(asked):
            return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()),
                             "most": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
        codes = _codes(list(words[home]))
        size = codes.shape[1]
        trie = Trie(_vectors(codes)[:, depth:], size + 3)
        middle = size // 2
        # For each half: words by (leaf, digest of the half).
        order, sorted_keys = [], []
        for digest in _halves(codes, middle, middle):
            key = (trie.leaf.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ digest
            order.append(np.argsort(key, kind="stable"))
            sorted_keys.append(key[order[-1]])
        pairs = [(home[:0], home[:0])]
        longer = np.array([len(words[i]) > size for i in asked])
        for extra in (False, True):
            own = asked[longer == extra]
            for start in range(0, len(own), QUERIES):
                block = own[start:start + QUERIES]
                other = _codes(list(words[block]))
                digests = _halves(other, middle, middle + extra)
                for query, leaf, spent in trie.leaves(_vectors(other)[:, depth:], state[block].astype(np.int64),
                                                      np.full(len(block), extra)):
                    for half in (0, 1):
                        key = (leaf.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ digests[half][query]
                        low = np.searchsorted(sorted_keys[half], key, "left")
                        high = np.searchsorted(sorted_keys[half], key, "right")
                        for cut in range(0, len(low), 1 << 16):
                            which, place = _ranges(low[cut:cut + (1 << 16)], high[cut:cut + (1 << 16)])
                            which += cut
                            for part in range(0, len(which), 1 << 18):
                                w, p = which[part:part + (1 << 18)], place[part:part + (1 << 18)]
                                q, h = query[w], order[half][p]
                                fine = trie.leaf[h] == leaf[w]
                                q, h, s = q[fine], h[fine], spent[w[fine]]
                                fine = _verified(other[q], codes[h], half, s)
                                pairs.append((block[q[fine]], home[h[fine]]))
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        # Of each word: how many near ones, and the best of them.
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda i: words[i])] = np.arange(len(words))
        turn = np.lexsort((rank[b], -n[b], a))
        a, b = a[turn], b[turn]
        firsts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        return pa.table({"word": pa.array(list(words[a[firsts]]), pa.string()),
                         "n_near": pa.array(np.diff(np.r_[firsts, len(a)]).astype(np.int64)),
                         "most": pa.array(n[b[firsts]]), "best": pa.array(list(words[b[firsts]]), pa.string())})
    return each


def _verified(queries: np.ndarray, words: np.ndarray, half: int, spent: np.ndarray) -> np.ndarray:
    """Which rows differ by one letter; a pair that both halves propose counts with the first."""
    size = words.shape[1]
    middle = size // 2
    if not len(words) or not size:
        return np.full(len(words), queries.shape[1] > size)
    if queries.shape[1] == size:
        differs = queries != words
        fine = differs.sum(1) == 1
        at = differs.argmax(1)
        rows = np.arange(len(words))
        # Words of one vector meet from both sides: the smaller one asks.
        return fine & ((spent != SAME) | (queries[rows, at] < words[rows, at]))
    ahead = np.minimum.accumulate(queries[:, :size] == words, axis=1).sum(1)
    behind = np.minimum.accumulate((queries[:, 1:] == words)[:, ::-1], axis=1).sum(1)
    fine = ahead + behind >= size
    return fine & (ahead < middle) if half else fine


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, most, best): for each word of (word, n) that has near words, their number, the largest n among them,
    and the word that has it."""
    words = common.stored(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    count = words.count()
    depth = min(GROUPS, max(LEVELS, math.ceil(math.log(max(count, 1) / ALIKE) / math.log(3))))
    dealt = common.stored(words.mapInArrow(_dealt(depth), "cell binary, state tinyint, word string, n bigint"), "dealt")
    sizes = dealt.groupBy("cell").agg(F.count_if(F.col("state") == HOME).alias("home"),
                                      F.count_if(F.col("state") != HOME).alias("asked"))
    sizes = sizes.where("home > 0 and asked > 0").select(
        F.col("cell").alias("c"), F.ceil(F.col("home") / CELL).cast("int").alias("homes"),
        F.ceil(F.col("asked") / (8 * CELL)).cast("int").alias("asks"))
    split = dealt.join(sizes, F.col("cell") == F.col("c"))
    own = F.xxhash64("word")
    at_home = F.col("state") == HOME
    tile = F.when(at_home, F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda k: F.struct(
        F.pmod(own, "homes").cast("int").alias("x"), k.alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda k: F.struct(
            k.alias("x"), F.pmod(own, "asks").cast("int").alias("y"))))
    tiles = split.select("cell", "state", "word", "n", F.explode(tile).alias("t")).select("cell", "t.*", "state", "word", "n")
    told = tiles.groupBy("cell", "x", "y").applyInArrow(_near(depth), "word string, n_near bigint, most bigint, best string")
    best = F.min(F.struct((-F.col("most")).alias("most"), F.col("best").alias("best"))).alias("first")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("first.most")).alias("most"), F.col("first.best").alias("best"))


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).  A word's form is its near word of largest n, if
    that is at least ``times`` its own; its root is the last of its forms' forms, itself if it has none."""
    words = common.stored(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words).withColumnRenamed("word", "w")
    fits = F.col("most") >= times * F.col("n")
    out = common.stored(words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("most")).alias("form_n")), "forms")
    # Forms grow at least ``times``-fold, so chains are short; every round doubles the length that is known.
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(7):
        ahead = roots.select(F.col("word").alias("w"), F.col("root").alias("further"))
        longer = common.stored(roots.join(ahead, F.col("root") == F.col("w"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("forms run in a circle")
    return out.join(roots.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Near-duplicate texts: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and their
components.

Candidates come from MinHash: 100 minima per text in 20 bands of 5, so a pair at similarity 0.8 shares a band with
probability 1 - (1 - 0.8^5)^20 = 0.9996, and one above it with more.  Every link is then verified by its exact shingle
sets, so texts below the threshold are never linked by themselves.

Texts of equal sets are one node (a 64-bit digest of the set).  The work is done in two turns, so that no turn puts out the
pairs of a group.  First, each bucket compares its nodes with its most central one, the node whose buckets are fullest: in a group
of copies that is the text they come from, and n copies cost about n comparisons.  A leader's set travels once for
some hundred nodes, never beside each of them.  Second, buckets that still hold several components go, in blocks of bounded size,
to tasks that find out by the minima alone which nodes have a promising partner in another component (the first bucket that two nodes
share answers for them); those nodes' sets, sent once to each block, are counted against each other through posting lists
and joined at once, so a block leaves a spanning tree.

The minima sort out a pair below 62 of 100 equal ones (a pair at 0.8 falls below that in 2 of 100,000 cases), or whose sizes
alone exclude a similarity of 0.8.

Edge cases: a text of fewer than five words is one shingle; a null text has no words, and texts without words equal each
other and nothing else.  A row without id has no component.  Rows of equal id stay or go together.  Empty tables give empty
tables; columns other than id and text are ignored, whatever their names.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common
from tablewright.llm.components import components
from tablewright.llm.simhash import shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
MINIMA = BANDS * ROWS
AGREE = 62        # of the 100 minima, for an exact comparison
FOLLOWERS = 256   # nodes that are compared with a leader in one go
BLOCK = 2048      # larger sides of a bucket are cut, also above
BLOCK_SHINGLES = 1 << 20
SALTS = 8
_DRAWN = np.random.default_rng(20).integers(0, 1 << 63, MINIMA + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS, MIX = _DRAWN[:MINIMA], _DRAWN[MINIMA:]


# ---------------------------------------------------------------- shingles and minima

def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the word shingles of a text, in order."""
    return np.unique(np.array(shingle_hashes((text or "").encode(), width), np.uint64))


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of non-empty sets: one row per factor, one column per set."""
    hashes = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(hashes * factor, starts) for factor in FACTORS])


def _signatures(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, 1):
            sets = [shingle_set(t, width) for t in piece.column(1).to_pylist()]
            nodes = np.array([set_digest(s) for s in sets], np.uint64).view(np.int64)
            full = [i for i, s in enumerate(sets) if len(s)]
            minis: list = [None] * len(sets)
            bands: list = [[]] * len(sets)
            if full:
                least = minima([sets[i] for i in full])
                low = np.ascontiguousarray(least.astype(np.uint8).T)
                keys = (least.reshape(BANDS, ROWS, -1) * MIX[None, :, None]).sum(1, dtype=np.uint64).T
                keys = np.ascontiguousarray(keys).view(np.int64)
                for place, i in enumerate(full):
                    minis[i], bands[i] = low[place].tobytes(), keys[place]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(nodes), pa.array(minis, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())],
                ["id", "tag", "node", "minima", "bands", "size"])
    return each


def _sets(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, 1):
            sets = [shingle_set(t, width).tobytes() for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])
    return each


# ---------------------------------------------------------------- in the tasks

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of one group after the other; rows come sorted by their first column, a group number."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        for start, stop in zip(starts, np.r_[starts[1:], len(groups)]):
            part = batch.slice(int(start), int(stop - start))
            if held and held[-1].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _sets_in(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The sets of a binary column, not copied."""
    return [np.frombuffer(value.as_buffer(), np.uint64) for value in column]


def _promising(similarity: float):
    """Pairs whose minima and sizes leave room for the similarity."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3))
            m, n = (batch.column(k).to_numpy() for k in (4, 5))
            fine = ((left == right).sum(1) >= AGREE) & (np.minimum(m, n) >= similarity * np.maximum(m, n))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine)) for c in batch.columns[:2]], ["u", "v"])
    return each


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _followers(similarity: float):
    """Verified links of rows (u, part, role, node, set) that are sorted by u, part and role: the leader comes first."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.empty(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for u, part, role, node, found in zip(*(batch.column(k).to_pylist() for k in range(4)), _sets_in(batch.column(4))):
                if role == 0:
                    leader, own = (u, part), found.copy()  # the batch may go before its followers do
                elif (u, part) == leader:
                    both = _common(own, found)
                    if both / (len(own) + len(found) - both) >= similarity:
                        us.append(u)
                        vs.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
    return each


def hopeful(minis: np.ndarray, size: np.ndarray, component: np.ndarray, other: np.ndarray, bands: np.ndarray, band: int,
            similarity: float = SIMILARITY) -> np.ndarray:
    """Which nodes of a block have a promising partner in another component, if no earlier band is theirs.  ``other`` nodes
    are held against the rest; without a rest, against each other."""
    rows, partners = np.flatnonzero(other), np.flatnonzero(~other)
    if not len(partners):
        partners = rows
    planes = np.ascontiguousarray(minis[partners].T)
    out = np.zeros(len(size), bool)
    for start in range(0, len(rows), 64):
        own = rows[start:start + 64]
        same = np.zeros((len(own), len(partners)), np.uint8)
        for k, plane in enumerate(planes):
            same += minis[own, k][:, None] == plane
        fine = same >= AGREE
        fine &= component[own][:, None] != component[partners]
        m, n = size[own][:, None], size[partners]
        fine &= np.minimum(m, n) >= similarity * np.maximum(m, n)
        if fine.any():
            for k in range(band):
                fine &= bands[own, k][:, None] != bands[partners, k]
            out[own] |= fine.any(1)
            out[partners] |= fine.any(0)
    return out


def _hopeful(similarity: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            size, component, other = (rows.column(k).to_numpy() for k in ("size", "component", "other"))
            minis = np.frombuffer(b"".join(rows.column("minima").to_pylist()), np.uint8).reshape(-1, MINIMA)
            bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            told = np.flatnonzero(hopeful(minis, size, component, other, bands, rows.column("band")[0].as_py(), similarity))
            if len(told):
                yield from rows.select(["group", "node", "component"]).take(pa.array(told)).combine_chunks().to_batches()
    return each


def joined(sets: list[np.ndarray], component: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places of similar pairs that connect components: at most one fewer than there are components."""
    sizes = np.array([len(s) for s in sets])
    holder = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings = holder[np.argsort(column, kind="stable")]
    stops = np.cumsum(count)
    starts = stops - count
    begin = np.cumsum(sizes) - sizes
    _, label = np.unique(component, return_inverse=True)
    root = np.arange(label.max() + 1)

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i
    links = []
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero(label != largest).tolist():
        own = column[begin[i]:begin[i] + sizes[i]]
        low, many = starts[own], count[own]
        places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        both = np.bincount(postings[places], minlength=len(sets))
        near = np.flatnonzero(both / (sizes + sizes[i] - both) >= similarity)
        for j in near[np.unique(label[near], return_index=True)[1]].tolist():  # one of each component will do
            a, b = top(label[i]), top(label[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _joined(similarity: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            node = rows.column("node").to_numpy()
            found = joined(_sets_in(rows.column("shingles")), rows.column("component").to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()),
                                              pa.array([node[j] for _, j in found], pa.int64())], ["u", "v"])
    return each


# ---------------------------------------------------------------- the two turns

def _salted(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Join a table with hot keys to one row per key; the rows of a key go to several tasks."""
    salt = F.pmod(F.xxhash64(F.lit("salt"), by), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return many.withColumn("salt", salt).join(few.withColumn("salt", salts), [key, "salt"]).drop("salt")


def _with_leaders(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The verified ones of distinct pairs (u leader, v)."""
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts"))
    dealt = _salted(pairs, parts, "u", "v").select(
        "u", F.pmod(F.xxhash64(F.lit("part"), "v"), "parts").cast("int").alias("part"), "v")
    dealt = common.stored(dealt, "dealt")
    follow = dealt.join(sets, F.col("v") == F.col("node")).select("u", "part", F.lit(1).alias("role"), "node", "shingles")
    lead = dealt.select(F.col("u").alias("x"), "part").distinct().join(sets, F.col("x") == F.col("node")).select(
        F.col("x").alias("u"), "part", F.lit(0).alias("role"), "node", "shingles")
    return (follow.union(lead).repartition("u", "part").sortWithinPartitions("u", "part", "role")
            .mapInArrow(_followers(similarity), "u bigint, v bigint"))


def _blocks(members: DataFrame, leaders: DataFrame, nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, in groups of bounded size: those outside of the leader's
    component with those inside, and with each other."""
    known = nodes.join(reached.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "node", "minima", "bands", "size", F.coalesce("component", "node").alias("component"))
    rows = common.stored(members.join(known.select("node", "component", "size"), "node"), "bucket_rows")
    first = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    first = (first.where("low <> high").select("key").join(leaders, "key")
             .join(known.select(F.col("node").alias("leader"), F.col("component").alias("first")), "leader"))
    first = common.stored(first, "open")
    sides = common.stored(_salted(rows, first, "key", "node").where("node <> leader")
                          .withColumn("other", F.col("component") != F.col("first")), "sides")
    most = lambda test: F.ceil(F.greatest(
        F.count_if(test) / BLOCK, F.sum(F.when(test, F.col("size")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    counts = sides.groupBy("key").agg(F.count("*").alias("n"), most(F.col("other")).alias("ob"), most(~F.col("other")).alias("fb"))
    counts = common.stored(counts.where("ob > 0 and n > 1").drop("n"), "blocks")
    rows = _salted(sides, counts, "key", "node")
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.when(F.col("other"), F.col("ob")).otherwise(F.col("fb")))

    def numbers(count):
        return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))

    cross = lambda f, o: F.xxhash64("key", F.lit("cross"), f.cast("bigint"), o.cast("bigint"))
    inner = lambda a, b: F.xxhash64("key", F.lit("inner"), F.least(a, b).cast("bigint"), F.greatest(a, b).cast("bigint"))
    tile = F.when(F.col("other"), F.concat(F.transform(numbers(F.col("fb")), lambda f: cross(f, own)),
                                           F.transform(numbers(F.col("ob")), lambda o: inner(own, o.cast("bigint"))))
                  ).otherwise(F.transform(numbers(F.col("ob")), lambda o: cross(own, o)))
    tiles = rows.select("band", "node", "component", "other", F.explode(tile).alias("group"))
    return tiles.join(known.drop("component"), "node").select(
        "group", "node", "component", "other", "band", "size", "minima", "bands")


def near_duplicates(df: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``id_column`` and ``component_id`` (the smallest id that links reach) for every row."""
    common.small_batches(df.sparkSession)
    text = df[text_column].cast("string")
    docs = df.select(df[id_column].cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    rows = common.stored(docs.mapInArrow(
        _signatures(width), "id bigint, tag bigint, node bigint, minima binary, bands array<bigint>, size bigint"), "minima")
    nodes = common.stored(rows.where("id is not null").groupBy("node").agg(
        F.min(F.struct("id", "tag")).alias("row"), F.min("minima").alias("minima"), F.min("bands").alias("bands"),
        F.min("size").alias("size")), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("key"), "band", "node")
    full = common.stored(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "full")
    members = common.stored(_salted(banded, full, "key", "node"), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    central = members.select("key", "node").join(weight, "node").groupBy("key").agg(
        F.max(F.struct("weight", "node")).alias("best")).select("key", F.col("best.node").alias("leader"))
    leaders = common.stored(central, "leaders")
    pairs = (_salted(members.select("key", "node"), leaders, "key", "node").where("node <> leader")
             .select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct())
    seen = nodes.select("node", "minima", "size")
    v = seen.select(F.col("node").alias("v"), F.col("minima").alias("mv"), F.col("size").alias("sv"))
    u = seen.select(F.col("node").alias("u"), F.col("minima").alias("mu"), F.col("size").alias("su"))
    pairs = common.stored(_salted(pairs.join(v, "v"), u.join(leaders.select(F.col("leader").alias("l")).distinct(),
                                                             F.col("u") == F.col("l"), "left_semi"), "u", "v")
                          .select("u", "v", "mu", "mv", "su", "sv").mapInArrow(_promising(similarity), "u bigint, v bigint"), "pairs")

    def sets_of(wanted: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """The sets of the wanted nodes, and those that are known.  The texts that hold them are found by a merge join
        whatever the size, as the number of wanted nodes has no bound that allows another."""
        own = wanted.select("node").distinct()
        if known is not None:
            own = own.join(known.select("node"), "node", "left_anti")
        own = common.stored(own.join(nodes.select("node", "row.id", "row.tag"), "node"), "wanted")
        if known is not None and own.isEmpty():
            return known
        texts = docs.join(own.hint("merge"), ["id", "tag"]).dropDuplicates(["id", "tag"]).select("node", "text")
        made = common.stored(texts.mapInArrow(_sets(width), "node bigint, shingles binary"), "sets")
        return made if known is None else known.unionByName(made)

    sets = sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")))
    links = common.stored(_with_leaders(pairs, sets, similarity), "verified")
    blocks = _blocks(members.select("key", "band", "node"), leaders, nodes, components(links))
    hopes = common.stored(blocks.repartition("group").sortWithinPartitions("group").mapInArrow(
        _hopeful(similarity), "group bigint, node bigint, component bigint"), "hopes")
    more = (hopes.join(sets_of(hopes, sets), "node").select("group", "node", "component", "shingles").repartition("group")
            .sortWithinPartitions("group").mapInArrow(_joined(similarity), "u bigint, v bigint"))
    reached = components(links.union(more))
    named = nodes.select("node", F.col("row.id").alias("id")).join(
        reached.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "node", "id", F.coalesce("component", "node").alias("component"))
    named = common.stored(named, "named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = common.stored(_salted(named, least, "component", "node").select("node", "component_id"), "known")
    out = _salted(rows.select("id", "node"), known, "node", "id").select("id", "component_id").where("id is not null")
    none = rows.where("id is null").select("id", F.lit(None).cast("bigint").alias("component_id"))
    return out.union(none).withColumnRenamed("id", id_column)


def one_of_each(df: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, and those without id.  Ids name documents: rows
    of equal id stay or go together."""
    found = near_duplicates(df, similarity, width, id_column, text_column)
    gone = found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("__gone")).distinct()
    gone = common.stored(gone, "gone")  # its true size decides how it is joined
    return df.join(gone, df[id_column].cast("bigint") == gone["__gone"], "left_anti")

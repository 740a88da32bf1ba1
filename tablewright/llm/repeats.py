"""Repeated passages across documents, by enhanced suffix arrays with an interval tree.

A suffix array of a whole corpus does not fit anywhere, so the suffixes are dealt out first.  Every window of ``length``
bytes has an anchor: the smallest hash among its pieces of ``PIECE`` bytes, leftmost on ties.  Equal windows have equal
anchors at the same place, so all suffixes that share ``length`` bytes meet if suffixes are dealt out by the hash of their
anchor.  Windows next to each other mostly share an anchor; they travel as one segment of fewer than twice ``length`` bytes.

1. Documents are packed into compressed blocks of a few megabytes and stored, with a digest of each text.  Whole texts
   that occur again are found by digest: the later document is one span from its begin to its end, and the document with
   the smallest id stands for all of them from here on.
2. Each block sends the distinct hashes of its anchors to buckets, with one bit: whether several of its texts have it; a
   bucket answers each block with one bit per hash: whether another text has it too.  All else is unique, and stays
   where it is.
3. Blocks send the segments of the anchors that are left, each different segment once, with its places and its smallest
   document.  A bucket sorts the suffixes of all segments (the suffix array), takes the common prefixes of neighbours, and
   scans them with a stack for the intervals of the common-prefix tree.  An interval whose suffixes are preceded by
   different bytes (or begin a segment) is maximal: a group of occurrences with its length and its smallest document.
   Intervals with equal left context are left out, because the suffixes one byte before say more.  A segment that only
   occurs whole is its own maximal group and needs no sorting.
4. The groups' places go back to the blocks, and a byte goes if a group covers it whose smallest document is smaller.

A passage that fills a third of all documents costs one segment per block.  Matches never cross documents.  Blocks and
buckets exchange a row per pair, so what a row takes by itself has to be small: nothing goes over all of a block or of a
bucket once per row.

Edge cases: a null text counts as empty.  Rows of equal id do not remove from each other.  A row without id removes from
no other and loses what any document with id has.  Empty tables give empty tables; columns other than id and text are
ignored.  A document has to fit into a task's memory.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

LENGTH = 50
PIECE = 24
BLOCK_BYTES = 1 << 22
CHUNK = 1 << 18
NO_ID = np.iinfo(np.int64).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


_TEXT = pa.struct([("id", pa.int64()), ("digest", pa.binary()), ("begin", pa.int64()), ("size", pa.int64())])


# ---------------------------------------------------------------- blocks

def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of any type behind each other, compressed."""
    raw = b"".join(struct.pack("<cq", a.dtype.char.encode(), len(a)) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        kind, n = struct.unpack_from("<cq", raw, at)
        out.append(np.frombuffer(raw, kind.decode(), n, at + 9))
        at += 9 + out[-1].nbytes
    return out


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> pa.RecordBatch:
        nonlocal number, held, size
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = common.text_bytes(table.column(1).chunk(0) if table.num_rows else pa.array([], pa.string()))
        ids = pc.fill_null(table.column(0), NO_ID).to_numpy()
        null = np.flatnonzero(pc.is_null(table.column(0)).to_numpy())
        number += 1
        held, size = [], 0
        offsets = np.asarray(offsets, np.int64)
        digests = [hashlib.sha256(data[a:b]).digest()[:16] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()),
             pa.array([_pack([ids.astype(np.int64), null.astype(np.int64), offsets, data])], pa.binary()),
             pa.array([[{"id": i, "digest": d, "begin": b, "size": n} for i, d, b, n in zip(
                 ids.tolist(), digests, offsets.tolist(), np.diff(offsets).tolist())]], pa.list_(_TEXT))],
            ["block", "content", "texts"])

    for piece in common.pieces(batches, 1, BLOCK_BYTES):
        held.append(piece)
        size += piece.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield block()
    if held:
        yield block()


# ---------------------------------------------------------------- anchors

def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive, in ``data``) and anchor hash of the segments of all windows; texts are not crossed."""
    starts, ends, hashes = [], [], []
    # Texts of ``length`` bytes or more, taken in chunks of windows.
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    valid = np.repeat(np.tile([True, False], len(sizes)), np.stack([windows, sizes - windows], 1).ravel())
    for low in range(0, len(data) - length + 1, CHUNK):
        high = min(low + CHUNK, len(data) - length + 1)
        anchor = _anchors(data[low:high + length - 1], length)
        window = np.flatnonzero(valid[low:high])
        if not len(window):
            continue
        own = anchor[window]
        first = np.r_[True, (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)]
        first = np.flatnonzero(first)
        last = np.r_[first[1:], len(window)] - 1
        starts.append(window[first] + low)
        ends.append(window[last] + low + length)
        hashes.append(own[first] >> np.uint64(24))
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For every window: 40 bits of the smallest piece hash, then its place (leftmost of equals)."""
    # Hashes of pieces of 1, 2, 4, ... bytes, put together to PIECE bytes.
    power = {1: data.astype(np.uint64) + np.uint64(1)}
    base, width = {1: np.uint64(0x100000001B3)}, 1
    while 2 * width <= PIECE:
        h, b = power[width], base[width]
        with np.errstate(over="ignore"):
            power[2 * width] = h[:-width] * b + h[width:]
            base[2 * width] = b * b
        width *= 2
    whole, done = None, 0
    for part in sorted(power, reverse=True):
        if PIECE & part:
            with np.errstate(over="ignore"):
                tail = power[part][done:]
                whole = tail if whole is None else whole[:len(tail)] * base[part] + tail
            done += part
    with np.errstate(over="ignore"):
        whole = (whole ^ (whole >> np.uint64(31))) * _MIX
    least = (whole >> np.uint64(24) << np.uint64(24)) | np.arange(len(whole), dtype=np.uint64)
    have, want = 1, length - PIECE + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _own_segments(data: np.ndarray, offsets: np.ndarray, copies: list[dict] | None, length: int) -> tuple[np.ndarray, ...]:
    """The segments of all texts that do not copy a whole other one, and the text of each."""
    start, end, hashes = segments(data, offsets, length)
    text = np.searchsorted(offsets, start, "right") - 1
    if not copies:
        return start, end, hashes, text
    copied = np.zeros(len(offsets), bool)
    copied[np.searchsorted(offsets, [c["begin"] for c in copies], "right") - 1] = True
    own = ~copied[text]
    return start[own], end[own], hashes[own], text[own]


def _distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and whether more than one text has each."""
    both = np.sort(hashes << np.uint64(24) | text.astype(np.uint64))
    hashes = both >> np.uint64(24)
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][:len(hashes)])
    last = np.r_[first[1:], len(hashes)][:len(first)] - 1
    return hashes[first], both[first] != both[last]


def _dealt(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The values of ``key`` and the rows of each, in one sort."""
    order = np.argsort(key, kind="stable")
    values, first = np.unique(key[order], return_index=True)
    return list(zip(values.tolist(), np.split(order, first[1:])))


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``begin``, ``begin`` + 1 and so on, ``count`` of them, row behind row."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def _hash_lists(buckets: int, length: int):
    """Per block and bucket: the distinct anchor hashes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, content, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                _, _, offsets, data = _unpack(content.as_buffer())
                _, _, hashes, text = _own_segments(data, offsets, copies, length)
                distinct, shared = _distinct(hashes, text)
                dealt = _dealt((distinct % np.uint64(buckets)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in dealt], pa.int32()), pa.array([block] * len(dealt), pa.int64()),
                     pa.array([_narrow(distinct[own], shared[own]) for _, own in dealt], pa.binary())],
                    ["bucket", "block", "hashes"])
    return each


def _narrow(hashes: np.ndarray, shared: np.ndarray) -> bytes:
    """40-bit hashes in five bytes each, in columns; then one bit each."""
    wide = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return struct.pack("<i", len(hashes)) + wide.T.tobytes() + np.packbits(shared).tobytes()


def _wide(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, = struct.unpack_from("<i", blob)
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 4).reshape(5, n).T
    return out.view("<u8").ravel(), np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), 4 + 5 * n), count=n).astype(bool)


def _answers(table: pa.Table) -> pa.Table:
    """One bit per hash of every block: more than one text has it.  A block names a hash once."""
    lists = [_wide(b) for b in table.column("hashes").to_pylist()]
    sizes = [len(x[0]) for x in lists]
    every, shared = (np.concatenate([x[i] for x in lists]) for i in range(2))
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    times = np.diff(np.r_[first, len(ranked)])
    hit = np.empty(len(every), bool)
    hit[order] = np.repeat((times > 1) | np.logical_or.reduceat(shared[order], first), times)
    cuts = np.cumsum([0, *sizes])
    bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


# ---------------------------------------------------------------- segments and their suffixes

def _send(buckets: int, length: int):
    """Per block and bucket: the different segments whose anchor another document has too."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, content, copies, answers in zip(batch.column(0).to_pylist(), batch.column(1),
                                                       batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids, _, offsets, data = _unpack(content.as_buffer())
                start, end, hashes, in_text = _own_segments(data, offsets, copies, length)
                distinct, _ = _distinct(hashes, in_text)
                bits = {answer["bucket"]: answer["bits"] for answer in answers or []}
                kept = np.zeros(len(distinct), bool)
                for b, own in _dealt((distinct % np.uint64(buckets)).astype(np.int64)):
                    kept[own] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(own))
                use = kept[np.searchsorted(distinct, hashes)]
                start, size, hashes, in_text = start[use], (end - start)[use], hashes[use], in_text[use]
                if not len(start):
                    continue
                owner = ids[in_text]
                digest = _digest(_rows(data, start, size, 2 * length - PIECE))
                order = np.lexsort((owner, digest, size, hashes))
                start, size, hashes, owner, digest = (x[order] for x in (start, size, hashes, owner, digest))
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (size[1:] != size[:-1]) | (digest[1:] != digest[:-1])]
                first = np.flatnonzero(new)
                count = np.diff(np.r_[first, len(start)])
                largest = np.maximum.reduceat(owner, first)
                dealt = _dealt((hashes[first] % np.uint64(buckets)).astype(np.int64))
                blobs = []
                for _, own in dealt:
                    rows = first[own]
                    places = start[_spread(rows, count[own])]
                    blobs.append(_pack([hashes[rows], size[rows].astype(np.int16), owner[rows], largest[own],
                                        count[own].astype(np.int32), places.astype(np.int32 if len(data) < 1 << 31 else np.int64),
                                        data[_spread(start[rows], size[rows])]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in dealt], pa.int32()), pa.array([block] * len(dealt), pa.int64()),
                     pa.array(blobs, pa.binary())], ["bucket", "block", "segments"])
    return each


def _rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The pieces of ``data`` as rows of a matrix of words, filled up with zeros."""
    width = -(-width // 8) * 8
    out = np.empty((len(start), width // 8), np.uint64)
    columns = np.arange(width)
    every = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(width, np.uint8)], width)
    for i in range(0, len(start), CHUNK >> 4):
        part = slice(i, i + (CHUNK >> 4))
        out[part] = np.where(columns < size[part, None], every[start[part]], np.uint8(0)).view(">u8")
    return out


def _digest(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for column in words.T:
            out = (out ^ column) * _MIX
            out ^= out >> np.uint64(29)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two matrices of words share, row by row."""
    same = a.byteswap().view(np.uint8).reshape(len(a), -1) == b.byteswap().view(np.uint8).reshape(len(b), -1)
    return np.where(same.all(1), same.shape[1], same.argmin(1))


def maximal_groups(text: np.ndarray, size: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(segments, places in them, common length) of all maximal repeats of ``length`` bytes or more among the rows of
    ``text`` (bytes, filled up with zeros; ``size`` of them count), from the intervals of their enhanced suffix array."""
    rows, width = text.shape
    windows = size - length + 1
    owner = np.repeat(np.arange(rows), windows)
    place = _spread(np.zeros(rows, np.int64), windows)
    # Suffixes in one interval have the first window in common: those of a window that comes once are in none, and windows
    # are sorted some at a time, so that an anchor with very many segments takes memory for one of its windows, not for all.
    window = np.empty(len(owner), np.uint64)
    for i in range(0, len(owner), CHUNK >> 2):
        part = slice(i, i + (CHUNK >> 2))
        window[part] = _digest(_rows(text.ravel(), owner[part] * width + place[part], np.full(len(owner[part]), length), length))
    order = np.argsort(window, kind="stable")
    first = np.flatnonzero(np.r_[True, window[order][1:] != window[order][:-1]][:len(order)])
    count = np.diff(np.r_[first, len(order)])
    first, count = first[count > 1], count[count > 1]
    for _, own in _dealt(np.cumsum(count) // (CHUNK >> 1)):
        these = order[_spread(first[own], count[own])]
        yield from _intervals(text, size, length, owner[these], place[these])


def _intervals(text: np.ndarray, size: np.ndarray, length: int, owner: np.ndarray,
               place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The maximal repeats among these suffixes."""
    width = text.shape[1]
    suffix = _rows(text.ravel(), owner * width + place, size[owner] - place, width)
    left = np.where(place > 0, text[owner, np.maximum(place - 1, 0)].astype(np.int32), -1 - owner)
    order = np.lexsort((*suffix.T[::-1],))
    suffix, owner, place, left = suffix[order], owner[order], place[order], left[order]
    rest = size[owner] - place
    prefix = np.zeros(len(order) + 1, np.int64)
    prefix[1:-1] = np.minimum(_common(suffix[:-1], suffix[1:]), np.minimum(rest[:-1], rest[1:]))
    # Stack scan: (common length, first suffix, the byte before all suffixes so far or None if it differs).
    stack: list[list] = []
    lengths, before = prefix.tolist(), left.tolist()
    for i in range(1, len(lengths)):
        now = lengths[i]
        first, context = i - 1, before[i - 1]
        while stack and stack[-1][0] > now:
            common_length, first, known = stack.pop()
            context = known if known == context else None
            if context is None:
                yield owner[first:i], place[first:i], common_length
        if now >= length:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != context:
                    stack[-1][2] = None
            else:
                stack.append([now, first, context])


def _telling(member: np.ndarray, offset: np.ndarray, reach: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, ...]:
    """Without the groups that say nothing new about a suffix: a shorter one counts if its document is smaller."""
    order = np.lexsort((document, -reach, offset, member))
    member, offset, reach, document = member[order], offset[order], reach[order], document[order]
    new = np.ones(len(order), bool)
    new[1:] = (member[1:] != member[:-1]) | (offset[1:] != offset[:-1]) | (document[1:] < document[:-1])
    return member[new], offset[new], reach[new], document[new]


def _groups(length: int):
    def settle(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        lists = [_unpack(b) for b in table.column("segments").to_pylist()]
        hashes, size, least, most, count, _, data = (np.concatenate([x[i] for x in lists]) for i in range(7))
        size = size.astype(np.int64)
        block = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
        places = np.concatenate([x[5].astype(np.int64) for x in lists])
        place_at = np.cumsum(np.r_[0, count])
        starts = np.cumsum(np.r_[0, size])[:-1]
        digest = _digest(_rows(data, starts, size, 2 * length - PIECE))
        order = np.lexsort((digest, size, hashes))
        new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (size[order][1:] != size[order][:-1])
                    | (digest[order][1:] != digest[order][:-1])]
        kind = np.empty(len(order), np.int32)
        kind[order] = np.cumsum(new) - 1           # equal segments have one number
        first = np.flatnonzero(new)
        sample = order[first]
        smallest = np.minimum.reduceat(least[order], first)
        anchor = hashes[sample]
        anchors = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        bounds = np.r_[anchors, len(anchor)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        # A segment occurs whole, and its smallest document is known: one maximal group per kind.
        kinds = np.arange(len(sample), dtype=np.int32)
        found.append((kinds, np.zeros(len(kinds), np.int16), size[sample].astype(np.int16), smallest))
        wide = np.flatnonzero(np.diff(bounds) > 1)
        step = []
        total = 0
        for g in [*wide.tolist(), None]:
            if g is not None:
                step.append(np.arange(bounds[g], bounds[g + 1]))
                total += len(step[-1])
            if step and (g is None or total >= 1 << 12):
                own = np.concatenate(step)
                text = _rows(data, starts[sample[own]], size[sample[own]], 2 * length - PIECE)
                text = text.astype(">u8").view(np.uint8).reshape(len(own), -1)
                groups, held = [], 0
                for which, offset, reach in maximal_groups(text, size[sample[own]], length):
                    member = own[which]
                    groups.append((member.astype(np.int32), offset.astype(np.int16), np.full(len(member), reach, np.int16),
                                   np.full(len(member), smallest[member].min())))
                    held += len(member)
                    if held >= CHUNK:
                        found.append(_telling(*map(np.concatenate, zip(*groups))))
                        groups, held = [], 0
                if groups:
                    found.append(_telling(*map(np.concatenate, zip(*groups))))
                step, total = [], 0
        member, offset, reach, document = map(np.concatenate, zip(*found))
        # Back from kinds to the segments of the blocks, unless none of a segment's documents can lose bytes by it.
        order = np.argsort(member, kind="stable")
        member, offset, reach, document = member[order], offset[order], reach[order], document[order]
        low, high = np.searchsorted(member, kind), np.searchsorted(member, kind, "right")
        times = high - low
        segment = np.repeat(np.arange(len(kind)), times)
        entry = _spread(low, times)
        use = document[entry] < most[segment]
        segment, entry = segment[use], entry[use]
        times = count[segment].astype(np.int64)
        begin = places[_spread(place_at[segment], times)] + np.repeat(offset[entry], times)
        entry = np.repeat(entry, times)
        blobs, back = [], []
        for b, own in _dealt(np.repeat(block[segment], times)):
            back.append(blocks[b])
            blobs.append(_pack([begin[own], reach[entry[own]].astype(np.int16), document[entry[own]]]))
        return pa.table({"block": pa.array(back, pa.int64()), "spans": pa.array(blobs, pa.binary())})
    return settle


# ---------------------------------------------------------------- what goes

def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, spans, copies in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ids, null, offsets, data = _unpack(content.as_buffer())
            lists = [_unpack(s) for s in spans or []]
            lists += [np.array([[c["begin"], c["size"], c["least"]] for c in copies or []], np.int64).reshape(-1, 3).T]
            begin, reach, document = (np.concatenate([x[i] for x in lists]).astype(np.int64) for i in range(3))
            use = document < ids[np.searchsorted(offsets, begin, "right") - 1] if len(begin) else np.empty(0, bool)
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, begin[use], 1)
            np.add.at(change, (begin + reach)[use], -1)
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            rows = []
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                rows.append((int(b - a), int(own.sum()), len(edges) // 2, edges.astype("<u4").tobytes(),
                             data[a:b][~own].tobytes()))
            mask = np.zeros(len(ids), bool)
            mask[null] = True
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=mask), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def remove_repeats(df: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text",
                   bucket_blocks: int = 4) -> DataFrame:
    """``id_column``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (begin and end of each removed run, little-endian
    unsigned 32-bit integers) and ``kept`` (the bytes that stay) for every row.  ``length`` is above ``PIECE``;
    ``bucket_blocks`` is how many blocks' worth of anchors a bucket holds about."""
    common.small_batches(df.sparkSession)
    rows = df.select(df[id_column].cast("bigint").alias("id"), df[text_column].cast("string").alias("text"))
    blocks = common.stored(rows.mapInArrow(_to_blocks, "block bigint, content binary, texts array<struct<id: bigint, digest: binary, begin: bigint, size: bigint>>"), "blocks")
    buckets = max(1, -(-blocks.count() // bucket_blocks))
    # Copies of whole texts: all but the smallest document of a digest.
    texts = blocks.select("block", F.explode("texts").alias("t")).where(F.col("t.size") >= length).select("block", "t.*")
    several = (texts.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("least"), F.max("id").alias("most"))
               .where("least < most").select("d", "least"))
    copies = common.stored(
        texts.join(several, F.col("digest") == F.col("d")).where("id > least").groupBy(F.col("block").alias("c"))
        .agg(F.collect_list(F.struct("begin", "size", "least")).alias("copies")), "copies")
    # All joins with the blocks are left joins over the same columns, so that Spark shuffles the blocks once.
    contents = blocks.select("block", "content").join(copies, F.col("block") == F.col("c"), "left").select(
        "block", "content", "copies")
    lists = contents.mapInArrow(_hash_lists(buckets, length), "bucket int, block bigint, hashes binary")
    answers = lists.groupBy("bucket").applyInArrow(_answers, "block bigint, bucket int, bits binary")
    answers = answers.groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    sent = contents.join(answers, F.col("block") == F.col("b"), "left").select(
        "block", "content", "copies", "answers").mapInArrow(_send(buckets, length), "bucket int, block bigint, segments binary")
    spans = sent.groupBy("bucket").applyInArrow(_groups(length), "block bigint, spans binary")
    spans = spans.groupBy(F.col("block").alias("b")).agg(F.collect_list("spans").alias("spans"))
    return (contents.join(spans, F.col("block") == F.col("b"), "left").select("content", "spans", "copies")
            .mapInArrow(_cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans binary, kept binary")
            .withColumnRenamed("id", id_column))

"""Exact Jaccard join of documents on word shingles, with signature trees.

1. Each text becomes its set of 64-bit shingle hashes, a token bitmap of 2048 bits and
   a class id, a 63-bit digest of the set (equal sets share it, so copies count once).
2. Shingles that many documents share are found in one pass and ordered last; each
   class is routed by the first ``n - ceil(0.8 n) + 1`` shingles in that order. Two
   sets that link share one of them, whatever the order is, so nothing is lost.
3. The classes under a routing shingle are the leaves of a signature tree. Its nodes
   hold OR-combined bitmaps and size ranges: within a chunk of bounded size the tree
   stands in one task, and chunks are the leaves of upper levels, tables of nodes that
   are spread over tasks. Dual traversal goes down pairs of nodes, level by level, and
   drops a pair when the greatest overlap that bitmaps and sizes allow is too small, or
   when all documents below are known to be connected.
4. A group of near copies is connected without telling all its pairs: the trees are
   traversed in turns, and in all turns but the last a document tells at most one
   candidate of each traversal. What verified links connect is not compared again. The
   first turn takes, of each class, only the EARLY routing shingles least by hash, on
   which near copies mostly agree; the last two turns take all routes.
5. Candidates are verified on the whole sets: 100 * overlap >= 80 * union.

Memory: a task holds a chunk of a routing shingle, however many share it; shingles
shared by most documents are dealt over tasks by size and salt besides.

Defined results: a null or blank text has an empty set, links with nothing and is its
own component; a text shorter than a shingle is one shingle; very long texts are
compared whole; rows with a null doc_id take part, and their component_id is the least
doc_id of the others (null if there is none); repeated rows are copies; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.llm.common import Scratch, batches, bytes_column, mix64, trimmed
from fibrelark.llm.components import Labels

SHINGLE = 5
LANES = 32  # of 64 bits each in a bitmap
CHUNK = 512  # documents in one chunk
LEAF = 2  # children of a node within a chunk: the OR of more documents that are not alike is too full to exclude anything
FEW = 8  # documents whose pairs are compared without a tree
FAN = 16  # children of a node above chunks
EARLY = 4  # routing shingles of a class that the first turn takes
COMMON = 200_000  # shingles in the list of common ones: bounds what is broadcast
SLICE = 8192  # pairs of bitmaps compared at once, which bounds a worker's memory
# Hashes below this, a seventh of all, are the head of a set: more than the ninth that a link may lack.
HEAD = np.uint64((1 << 64) // 7)
REMEMBERED = 50_000  # pairs that a task does not tell twice
REMEMBERED_CLASSES = 1_000_000
PASS_SHINGLES = 1_000_000
BROADCAST_IDS = 1_000_000  # ids of candidates are broadcast up to this number, joined by a shuffle beyond
BROADCAST_ROWS = 250_000  # the same of ids with digests
# A chunk's number: band of sizes, salt, place; chunks of near sizes are near in number.
PLACES, SALTS = 1 << 20, 1 << 20
# Rows in an Arrow batch: of texts and sets, of pairs with both sets.
SET_ROWS, PAIR_ROWS = 2000, 256

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHashes(dict):
    """Word to its hash; forgets all when full, which bounds a worker's memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 60_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHashes()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return mix64((hashed * _FACTORS[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    total = hashed[: len(words) - SHINGLE + 1] * _FACTORS[0]
    for k in range(1, SHINGLE):
        total += hashed[k : len(words) - SHINGLE + 1 + k] * _FACTORS[k]
    return np.unique(mix64(total))


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sets in order."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges the two
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _least_overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """ceil(4 (a + b) / 9), the overlap that two sets of these sizes need."""
    return (4 * (a + b) + 8) // 9


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(LANES * 64, np.uint8)
    bits[(hashes >> np.uint64(53)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _lanes(column: pa.Array) -> np.ndarray:
    """Bitmaps as rows of 64-bit lanes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LANES)


DIGEST = ("text_1", "text_2")  # of the text, 128 bits in two columns
_SETS = "doc_id long, class_id long, n long, bits binary, hashes binary"


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # classes of this task, so that many copies bring their set once
    for batch in batches(parts):
        classes, sizes, bits, sets = [], [], [], []
        for text in bytes_column(batch, "text"):
            hashes = shingle_set(text)
            sizes.append(len(hashes))
            if not len(hashes):
                classes.append(None)
                bits.append(None)
                sets.append(None)
                continue
            digest = int(mix64(hashes.sum(dtype=np.uint64, keepdims=True) + np.bitwise_xor.reduce(mix64(hashes)))[0]) >> 1
            classes.append(digest)
            first = digest not in seen
            if len(seen) >= REMEMBERED_CLASSES:
                seen.clear()
            seen.add(digest)
            bits.append(_bitmap(hashes).tobytes() if first else None)
            sets.append(hashes.tobytes() if first else None)
        ids = [k for k in ("doc_id", *DIGEST) if k in batch.schema.names]
        columns = [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(k)).cast(pa.int64()) for k in ids), *columns], names=[*ids, "class_id", "n", "bits", "hashes"]
        )
    _HASHES.clear()


def _often(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles found in three documents or more of a stretch of the task, with their number."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        much = counts >= 3
        return pa.RecordBatch.from_arrays([pa.array(values[much].view(np.int64)), pa.array(counts[much])], names=["h", "n"])

    held, n = [], 0
    for batch in batches(parts):
        for packed in batch.column(0).to_pylist():
            held.append(_unpack(packed))
            n += len(held[-1])
            if n >= PASS_SHINGLES:
                yield told(held)
                held, n = [], 0
    if held:
        yield told(held)


def _routing(common: np.ndarray, rank: np.ndarray, salts: np.ndarray):  # noqa: ANN202
    """Rows (h, salt, class_id, n, pos, common, early) of the routing prefix of each set.

    A common shingle is dealt by band of sizes (5/4 wide, so only neighbours can link) and
    by a salt that depends on the shingle too, so that other shingles mix the classes anew.
    """
    names = ["h", "salt", "class_id", "n", "pos", "common", "early"]

    def route(class_id: int, n: int, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        length = n - (4 * n + 4) // 5 + 1
        at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
        often = common[at] == hashes if len(common) else np.zeros(n, bool)
        rare = hashes[~often][:length]
        chosen, salt = rare, np.zeros(length, np.int64)
        if len(rare) < length:
            last = at[often][np.argsort(rank[at[often]], kind="stable")][: length - len(rare)]
            chosen = np.concatenate([rare, common[last]])
            own = mix64(common[last] ^ np.uint64(class_id)) % salts[last]
            band = int(np.log(n) / np.log(1.25))
            salt[len(rare) :] = np.where(salts[last] > 1, band * SALTS + own.astype(np.int64), 0)
        mixed = mix64(chosen)
        early = mixed <= np.partition(mixed, EARLY - 1)[EARLY - 1] if length > EARLY else np.ones(length, bool)
        place = np.arange(length, dtype=np.int32)
        return chosen.view(np.int64), salt, np.full(length, class_id, np.int64), np.full(length, n, np.int32), place, place >= len(rare), early

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = [route(c, n, _unpack(packed)) for c, n, packed in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    return run


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, salt, n, class_id): those that share a shingle, with their chunk.

    Holds a few chunks of one shingle at most.
    """
    names = ["h", "chunk", "class_id", "n", "pos", "common", "early"]
    held: list[np.ndarray] | None = None
    told_chunks = 0  # of the shingle and salt that the held rows begin with

    def told(rows: list[np.ndarray], first_chunk: int) -> pa.RecordBatch:
        h, salt, classes, sizes, pos, often, early = rows
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
        lengths = np.diff(np.r_[starts, len(h)])
        base = np.zeros(len(starts), np.int64)
        base[0] = first_chunk
        place = (np.arange(len(h)) - np.repeat(starts, lengths)) // CHUNK + np.repeat(base, lengths)
        keep = np.repeat((lengths > 1) | (base > 0), lengths) | often
        columns = (h, salt * PLACES + place, classes, sizes, pos, often, early)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=names)

    for batch in batches(parts):
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
        h, salt, classes = rows[:3]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (classes[1:] != classes[:-1])]  # copies of other tasks go
        rows = [x[fresh] for x in rows]
        h, salt = rows[0], rows[1]
        turns = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
        if len(turns):
            yield told([x[: turns[-1]] for x in rows], told_chunks)
            rows, told_chunks = [x[turns[-1] :] for x in rows], 0
        ready = (len(rows[0]) - 1) // CHUNK
        if ready >= 4:  # the shingle goes on: whole chunks leave, at least a row stays
            yield told([x[: ready * CHUNK] for x in rows], told_chunks)
            rows, told_chunks = [x[ready * CHUNK :] for x in rows], told_chunks + ready
        held = rows
    if held is not None:
        yield told(held, told_chunks)


def _heads(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set the shingles below HEAD, half of each hash: a fourteenth of the bytes."""
    for batch in batches(parts):
        heads = []
        for packed in batch.column(2).to_pylist():
            hashes = _unpack(packed)
            heads.append((hashes[: int(np.searchsorted(hashes, HEAD))] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.binary())], names=["class_id", "n", "head"])


def _likely(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that the heads of both sets do not exclude: what is missing there is missing from the overlap.

    Halves of hashes may agree by chance, which only keeps a pair for the whole comparison.
    """
    for batch in batches(parts):
        a, b, na, nb, x, y = (batch.column(k).to_pylist() for k in range(6))
        keep = []
        for n, m, one, two in zip(na, nb, x, y, strict=True):
            one, two = np.frombuffer(one, np.uint32), np.frombuffer(two, np.uint32)
            common = np.count_nonzero(np.isin(one, two))
            keep.append(min(n - len(one), m - len(two)) + common >= _least_overlap(n, m))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, k in zip(v, keep, strict=True) if k], pa.int64()) for v in (a, b)], names=["a", "b"])


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(parts):
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        links = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = _unpack(x), _unpack(y)
            both = _overlap(x, y)
            links.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, k in zip(v, links, strict=True) if k], pa.int64()) for v in (a, b)], names=["a", "b"])


def _feasible(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, chunk, n) those with a partner in their block that sizes and places allow and that is not connected.

    A block of more than one chunk is passed on whole, marked as wide, as it comes.
    """
    names = ["h", "chunk", "class_id", "n", "pos", "label"]

    def told(rows: dict[str, np.ndarray], starts: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        keep = [np.ones(j - i, bool) if w else wanted(rows, i, j) for i, j, w in zip(starts[:-1], starts[1:], wide, strict=True)]
        keep = np.concatenate(keep)
        return pa.RecordBatch.from_arrays([*(pa.array(v[: starts[-1]][keep]) for v in rows.values()), pa.array(np.repeat(wide, np.diff(starts))[keep])], names=[*names, "wide"])

    def wanted(rows: dict[str, np.ndarray], i: int, j: int) -> np.ndarray:
        label = rows["label"][i:j]
        if (label == label[0]).all():
            return np.zeros(j - i, bool)
        n, rest = rows["n"][i:j], rows["n"][i:j] - rows["pos"][i:j]
        ok = np.minimum(rest[:, None], rest[None, :]) >= _least_overlap(n[:, None], n[None, :])
        return (ok & (label[:, None] != label[None, :])).any(axis=1)

    held: dict[str, np.ndarray] | None = None
    wide_block = None  # the shingle at the end, if parts of it have left
    for batch in batches(parts):
        rows = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
        if held is not None:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        h = rows["h"]
        starts = np.r_[0, np.flatnonzero(np.diff(h) != 0) + 1]
        wide = (np.diff(np.r_[starts, len(h)]) > CHUNK) | (h[starts] == wide_block if wide_block is not None else False)
        if not wide[-1]:  # the last block may go on
            starts, wide, wide_block = starts, wide[:-1], None
        else:
            wide_block = h[-1]
            starts = np.r_[starts, len(h)]
        if len(wide):
            yield told(rows, starts, wide)
        held = {k: v[starts[-1] :] for k, v in rows.items()}
    if held is not None and len(held["h"]):
        yield told(held, np.array([0, len(held["h"])]), np.array([held["h"][0] == wide_block]) if wide_block is not None else np.zeros(1, bool))


def _bounds(rows: dict[str, np.ndarray], bits: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Nodes over the rows between starts: OR-combined bitmaps, and ranges of sizes, excess and labels."""
    ends = {"low": np.minimum, "high": np.maximum, "over": np.maximum, "first": np.minimum, "last": np.maximum}
    return np.bitwise_or.reduceat(bits, starts, axis=0), {k: f.reduceat(rows[k], starts) for k, f in ends.items()}


def _excess(sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """By how much a set is larger than the bits that it sets: overlaps may be larger than common bits by as much."""
    return sizes - np.bitwise_count(bits).sum(1).astype(np.int64)


def _possible(a: dict[str, np.ndarray], a_bits: np.ndarray, b: dict[str, np.ndarray], b_bits: np.ndarray) -> np.ndarray:
    """Which pairs of nodes may hold a link between documents not connected yet."""
    ok = (4 * b["low"] <= 5 * a["high"]) & (4 * a["low"] <= 5 * b["high"])
    ok &= np.minimum(a["first"], b["first"]) < np.maximum(a["last"], b["last"])
    at = np.flatnonzero(ok)
    for i in range(0, len(at), SLICE):
        part = at[i : i + SLICE]
        most = np.bitwise_count(a_bits[part] & b_bits[part]).sum(1).astype(np.int64) + np.minimum(a["over"][part], b["over"][part])
        ok[part] = most >= _least_overlap(a["low"][part], b["low"][part])
    return ok


def _signature_order(sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Documents by band of sizes (5/4 wide) and, within it, by the first bits of their bitmaps, so that nodes hold documents that are alike."""
    lowest = []
    for turn in range(3):  # the least position in a shuffled order of the lanes: sets that link mostly agree on it
        lanes = np.argsort(mix64(np.arange(LANES, dtype=np.uint64) + np.uint64(LANES * turn)))
        shuffled = bits[:, lanes]
        first = (shuffled != 0).argmax(axis=1)
        lane = shuffled[np.arange(len(bits)), first]
        lowest.append(first * 64 + np.bitwise_count((lane & (~lane + np.uint64(1))) - np.uint64(1)).astype(np.int64) % 64)
    band = (np.log(np.maximum(sizes, 1)) / np.log(1.25)).astype(np.int64)
    return np.lexsort((*reversed(lowest), band))


def _leaf_pairs(rows: dict[str, np.ndarray], bits: np.ndarray, side: np.ndarray | None, counted: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal of the tree over these documents, or of the trees of two chunks.

    Returns positions of the pairs that no bound excludes. ``side`` is 0 or 1 for
    documents of two chunks, of which only mixed pairs are wanted. ``counted`` is given
    the inner pairs of nodes that sizes and labels leave, and those that bitmaps leave too.
    """
    order = _signature_order(rows["n"], bits)
    rows, bits, side = {k: v[order] for k, v in rows.items()}, bits[order], None if side is None else side[order]
    sizes, pos = rows["n"], rows["pos"]
    levels = [(bits, {"low": sizes, "high": sizes, "over": _excess(sizes, bits), "first": rows["label"], "last": rows["label"]})]
    while len(levels[-1][0]) > 1:
        below, own = levels[-1]
        levels.append(_bounds(own, below, np.arange(0, len(below), LEAF)))
    left = right = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        b, own = levels[depth]
        if depth < len(levels) - 1:  # children of the pairs that are left
            grown = (left[:, None, None] * LEAF + np.arange(LEAF)[None, :, None] + np.zeros((1, 1, LEAF), np.int64)).reshape(-1)
            other = (right[:, None, None] * LEAF + np.arange(LEAF)[None, None, :] + np.zeros((1, LEAF, 1), np.int64)).reshape(-1)
            there = (grown < len(b)) & (other < len(b)) & (grown <= other)
            left, right = grown[there], other[there]
        kept = []
        for i in range(0, len(left), SLICE):
            x, y = left[i : i + SLICE], right[i : i + SLICE]
            kept.append(_possible({k: v[x] for k, v in own.items()}, b[x], {k: v[y] for k, v in own.items()}, b[y]))
        ok = np.concatenate(kept) if kept else np.zeros(0, bool)
        if counted is not None and 0 < depth < len(levels) - 1:
            full = np.full_like(b, ~np.uint64(0))
            by_size = _possible({k: v[left] for k, v in own.items()}, full[left], {k: v[right] for k, v in own.items()}, full[right])
            counted["sizes"] = counted.get("sizes", 0) + int((by_size & (left != right)).sum())
            counted["bitmaps"] = counted.get("bitmaps", 0) + int((ok & (left != right)).sum())
        left, right = left[ok], right[ok]
        if not len(left):
            return left, right
    ok = left != right
    if side is not None:
        ok &= side[left] != side[right]
    # If this is the first shingle that both share, no more than what follows it can be common.
    rest = np.minimum(sizes[left] - pos[left], sizes[right] - pos[right])
    ok &= rest >= _least_overlap(sizes[left], sizes[right])
    return order[left[ok]], order[right[ok]]


def _few_pairs(rows: dict[str, np.ndarray], bits: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for all trees of one node at once; ``ends`` has the end of each row's tree, and rows of a tree are in a row."""
    found = []
    sizes = rows["n"]
    over = _excess(sizes, bits)
    own = {"low": sizes, "high": sizes, "over": over, "first": rows["label"], "last": rows["label"]}
    for step in range(1, FEW):
        left = np.flatnonzero(np.arange(len(ends)) + step < ends)
        right = left + step
        rest = np.minimum(sizes[left] - rows["pos"][left], sizes[right] - rows["pos"][right])
        ok = rest >= _least_overlap(sizes[left], sizes[right])
        ok &= (rows["one"][left] == rows["two"][left]) | (rows["chunk"][left] != rows["chunk"][right])
        left, right = left[ok], right[ok]
        ok = _possible({k: v[left] for k, v in own.items()}, bits[left], {k: v[right] for k, v in own.items()}, bits[right])
        found.append((left[ok], right[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _traversal(turn: int | None):  # noqa: ANN202
    """Candidates of each run of rows sorted by (h, one, two, n).

    With a turn, a document of a run tells one pair at most: the partner that comes first in
    an order of this turn, if that is before itself. Without, all pairs are told.
    """
    names = ["h", "one", "two", "n", "pos", "class_id", "label", "chunk"]

    def told(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        if turn is not None and len(left):
            order = mix64(rows["class_id"].view(np.uint64) ^ np.uint64((turn + 1) * 0x9E3779B9))
            turned = order[left] > order[right]
            left, right = np.where(turned, right, left), np.where(turned, left, right)
            by = np.lexsort((order[left], right))
            left, right = left[by], right[by]
            first = np.r_[True, right[1:] != right[:-1]]
            left, right = left[first], right[first]
        a, b = rows["class_id"][left], rows["class_id"][right]
        return list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))

    def found(rows: dict[str, np.ndarray], bits: np.ndarray, starts: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        sizes = np.diff(starts)
        mixed = np.minimum.reduceat(rows["label"], starts[:-1]) < np.maximum.reduceat(rows["label"], starts[:-1])
        few = np.repeat(np.where(mixed & (sizes <= FEW), starts[1:], -1), sizes)
        if (few >= 0).any():
            at = np.flatnonzero(few >= 0)  # whole runs, so those next to each other stay so
            ends = np.searchsorted(at, few[at])
            some = {k: v[at] for k, v in rows.items()}
            yield told(some, *_few_pairs(some, bits[at], ends))
        for k in np.flatnonzero(mixed & (sizes > FEW)):
            i, j = starts[k], starts[k + 1]
            run = {name: v[i:j] for name, v in rows.items()}
            side = None if run["one"][0] == run["two"][0] else (run["chunk"] == run["two"]).astype(np.int64)
            yield told(run, *_leaf_pairs(run, bits[i:j], side))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        held_bits = np.zeros((0, LANES), np.uint64)
        told_before: set[tuple[int, int]] = set()

        def fresh(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
            pairs -= told_before
            if len(told_before) + len(pairs) > REMEMBERED:
                told_before.clear()
            told_before.update(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def runs(rows: dict[str, np.ndarray], bits: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            pairs: set[tuple[int, int]] = set()
            for some in found(rows, bits, starts):
                pairs.update(some)
                if len(pairs) > REMEMBERED:
                    yield fresh(pairs)
                    pairs = set()
            yield fresh(pairs)

        for batch in batches(parts):
            rows = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
            bits = _lanes(batch.column(batch.schema.get_field_index("bits")))
            if held is not None:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
                bits = np.concatenate([held_bits, bits])
            turns = np.flatnonzero((np.diff(rows["h"]) != 0) | (np.diff(rows["one"]) != 0) | (np.diff(rows["two"]) != 0)) + 1
            last = int(turns[-1]) if len(turns) else 0
            if last:
                yield from runs(rows, bits, np.r_[0, turns])
            held, held_bits = {k: v[last:] for k, v in rows.items()}, bits[last:]
        if held is not None:
            yield from runs(held, held_bits, np.array([0, len(held["h"])]))

    return run


_NODE = "h long, node long, low long, high long, over long, first long, last long, bits binary"
_RANGES = ["low", "high", "over", "first", "last"]


def _nodes_of(leaves: bool):  # noqa: ANN202
    """Nodes over rows sorted by (h, node): of documents (``leaves``) or of nodes of the level below."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "node", *(("n", "label") if leaves else _RANGES)]
        held: tuple[dict[str, np.ndarray], np.ndarray] | None = None

        def told(rows: dict[str, np.ndarray], bits: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            combined, ranges = _bounds(rows, bits, starts)
            columns = [pa.array(rows["h"][starts]), pa.array(rows["node"][starts]), *(pa.array(ranges[k]) for k in _RANGES)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in combined], pa.binary())], names=["h", "node", *_RANGES, "bits"])

        for batch in batches(parts):
            rows = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
            bits = _lanes(batch.column(batch.schema.get_field_index("bits")))
            if leaves:
                rows = {"h": rows["h"], "node": rows["node"], "low": rows["n"], "high": rows["n"], "over": _excess(rows["n"], bits), "first": rows["label"], "last": rows["label"]}
            if held is not None:
                rows, bits = {k: np.concatenate([held[0][k], v]) for k, v in rows.items()}, np.concatenate([held[1], bits])
            starts = np.r_[0, np.flatnonzero((np.diff(rows["h"]) != 0) | (np.diff(rows["node"]) != 0)) + 1]
            if len(starts) > 1:
                yield told({k: v[: starts[-1]] for k, v in rows.items()}, bits[: starts[-1]], starts[:-1])
            held = {k: v[starts[-1] :] for k, v in rows.items()}, bits[starts[-1] :]
        if held is not None:
            yield told(*held, np.zeros(1, np.int64))

    return run


def _node_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of nodes (x_..., y_...) those that bounds do not exclude."""
    for batch in batches(parts):
        get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        side = lambda s: {k: get(f"{s}_{k}").to_numpy(zero_copy_only=False) for k in _RANGES}  # noqa: B023, E731
        ok = pa.array(_possible(side("x"), _lanes(get("x_bits")), side("y"), _lanes(get("y_bits"))))
        yield pa.RecordBatch.from_arrays([get(k).filter(ok) for k in ("h", "one", "two")], names=["h", "one", "two"])


def digest_of(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), F.col(text)).alias(name) for k, name in enumerate(DIGEST)]


class JaccardJoin:
    """One run of the join over a table with doc_id and text; ``digests`` keeps digests of the texts, for surplus()."""

    def __init__(self, spark: SparkSession, docs: DataFrame, digests: bool = False) -> None:
        self.spark = spark
        self.scratch = Scratch(spark, "ngram-join")
        keys = [F.col("doc_id").cast("long").alias("doc_id"), *(digest_of("text") if digests else [])]
        schema = _SETS.replace("doc_id long", f"doc_id long, {DIGEST[0]} long, {DIGEST[1]} long") if digests else _SETS
        self.sets = self.scratch.write(docs.select(*keys, "text").mapInArrow(trimmed(_sets), schema), "sets", SET_ROWS)
        self.scratch.tidy()
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _common(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The common shingles in order of value, their rank in the routing order, and into how many parts each is dealt."""
        counted = self.sets.filter("hashes is not null").select("hashes").mapInArrow(trimmed(_often), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        often = self.scratch.write(counted.filter("n >= 16").orderBy(F.desc("n"), "h").limit(COMMON), "often", SET_ROWS)
        rows = sorted(((r["h"], r["n"]) for r in often.collect()), key=lambda r: (-r[1], r[0]))
        h, n = np.array(rows, np.int64).reshape(-1, 2).T
        rank = np.arange(len(rows), 0, -1, dtype=np.int64)  # the most common come last
        order = np.argsort(h.view(np.uint64))
        salts = np.clip(-(-n // CHUNK), 1, SALTS - 1).astype(np.uint64)
        return h.view(np.uint64)[order], rank[order], salts[order]

    def _of(self, ids: DataFrame, *columns: str) -> DataFrame:
        """The named columns of the classes with these ids (a column ``id``), once for each task that met them.

        Few ids go to the sets, many meet them by a shuffle.
        """
        first = self.sets.filter("hashes is not null").select("class_id", *columns)
        ids = ids.select("id").distinct()
        small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return first.join(F.broadcast(ids) if small else ids, F.col("class_id") == F.col("id"), "left_semi")

    def _paired(self, pairs: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """Pairs with the columns of both sides, as a_... and b_...; ``found`` has a row for each class and task."""
        there = self.scratch.write(found.dropDuplicates(["class_id"]), name, SET_ROWS)
        side = lambda s: there.select(F.col("class_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in there.columns[1:]])
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def _links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of classes that link: excluded by their heads (bitmaps of long sets are full), then verified on the whole sets."""
        scratch = self.scratch
        ids = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
        pairs = scratch.write(pairs, f"{name}-pairs")
        heads = self._of(ids(pairs), "n", "hashes").mapInArrow(trimmed(_heads), "class_id long, n long, head binary")
        both = self._paired(pairs, heads, f"{name}-heads").select("a", "b", "a_n", "b_n", "a_head", "b_head")
        near = scratch.write(both.mapInArrow(trimmed(_likely), "a long, b long"), f"{name}-near", SET_ROWS)
        both = self._paired(near, self._of(ids(near), "hashes"), f"{name}-sets").select("a", "b", "a_hashes", "b_hashes")
        links = scratch.write(both.mapInArrow(trimmed(_verify), "a long, b long"), name, PAIR_ROWS)
        for part in ("pairs", "heads", "near", "sets"):
            scratch.drop(f"{name}-{part}")
        scratch.tidy()
        return links

    def _labels(self) -> DataFrame:
        """node and label of each class that links with another."""
        scratch = self.scratch
        routed = self.sets.filter("hashes is not null").select("class_id", "n", "hashes").mapInArrow(
            trimmed(_routing(*self._common())), "h long, salt long, class_id long, n int, pos int, common boolean, early boolean"
        )
        shared = scratch.write(
            routed.repartition(self.parts, "h", "salt").sortWithinPartitions("h", "salt", "n", "class_id").mapInArrow(
                trimmed(_blocks), "h long, chunk long, class_id long, n int, pos int, common boolean, early boolean"
            ),
            "shared",
            2 * SET_ROWS,
        )
        del routed
        scratch.tidy()
        labels = Labels(scratch)
        early = self._with_bits(shared.filter("early").drop("early", "common").withColumn("wide", F.lit(False)), "early")
        labels.add(self._links(self._candidates(early, None, 0), "links-0"))
        leaves = self._with_bits(self._open(shared, labels.table), "leaves")
        for name in ("shared", "early"):
            scratch.drop(name)
        labels.add(self._links(self._candidates(leaves, labels.table, 1), "links-1"))
        labels.add(self._links(self._candidates(leaves, labels.table, None), "links-2"))
        return labels.table

    def _named(self, rows: DataFrame, low: Column, name: str) -> DataFrame:
        """own, a class, and the least ``low`` of the rows of its component."""
        lows = rows.filter("class_id is not null").groupBy("class_id").agg(F.min(low).alias("low"))
        classes = lows.join(self._labels(), F.col("class_id") == F.col("node"), "left").select("class_id", "low", F.coalesce("label", "class_id").alias("label"))
        classes = self.scratch.write(classes, "classes")
        self.scratch.keep("sets", "rows", "classes")
        least = classes.groupBy("label").agg(F.min("low").alias(name))
        return classes.join(least, "label").select(F.col("class_id").alias("own"), name)

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        # Documents to classes to components; the least doc_id of each comes back through partial sums.
        rows = self.sets.select("doc_id", "class_id", F.col("n").alias("n_shingles"))
        named = self._named(rows, F.col("doc_id"), "component_id")
        out = rows.join(named, F.col("class_id") == F.col("own"), "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

    def surplus(self) -> DataFrame:
        """doc_id, digest and ``more`` of texts that have a component: whether rows like this are all surplus, or all but one.

        The first of a component has the least doc_id, then the least digest; null ids come
        last. Of the first there is no row here if no other row equals it.
        """
        rows = self.sets.filter("class_id is not null").groupBy("doc_id", *DIGEST, "class_id").agg(F.count(F.lit(1)).alias("n"))
        rows = self.scratch.write(rows, "rows")
        named = self._named(rows, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *DIGEST), "first")
        same = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        for name in DIGEST:
            same &= F.col(name) == F.col(f"first.{name}")
        found = rows.join(named, F.col("class_id") == F.col("own")).select("doc_id", *DIGEST, same.alias("stays"), "n")
        found = found.filter("not stays or n > 1").select("doc_id", *DIGEST, (~F.col("stays")).alias("all"))
        surplus = self.scratch.write(found, "surplus")
        self.scratch.keep("surplus")
        self.scratch.tidy()
        return surplus

    def _with_bits(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows of blocks with the bitmaps of their classes, written."""
        rows = self.scratch.write(rows, f"{name}-rows")
        bits = self._of(rows.select(F.col("class_id").alias("id")), "bits").dropDuplicates(["class_id"]).select(F.col("class_id").alias("own"), "bits")
        columns = ["h", "chunk", "class_id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "wide", "bits"]
        leaves = self.scratch.write(rows.join(bits, F.col("class_id") == F.col("own")).select(columns), name)
        self.scratch.drop(f"{name}-rows")
        return leaves

    def _labelled(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("class_id"))
        return rows.join(labels, F.col("class_id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "class_id")).drop("node")

    def _open(self, shared: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of all blocks that hold documents not connected; wide tells blocks of several chunks."""
        named = self._labelled(shared.drop("early"), labels)
        columns = "h long, chunk long, class_id long, n long, pos long, label long, wide boolean"
        # Blocks of shingles that few share: only rows that still have a possible partner go on.
        few = named.filter("not common").drop("common").repartition(self.parts, "h").sortWithinPartitions("h", "chunk", "n").mapInArrow(trimmed(_feasible), columns)
        often = named.filter("common").drop("common")
        mixed = often.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), (F.min("chunk") < F.max("chunk")).alias("wide"))
        mixed = mixed.filter("lo <> hi").select(F.col("h").alias("mixed"), "wide")
        often = often.join(F.broadcast(mixed), F.col("h") == F.col("mixed"))  # at most COMMON rows
        names = ["h", "chunk", "class_id", "n", "pos", "wide"]
        return few.select(names).union(often.select(*names[:3], *[F.col(c).cast("long") for c in ("n", "pos")], "wide"))

    def _chunk_pairs(self, wide: DataFrame, turn: int | None) -> DataFrame:
        """h, one, two: pairs of chunks that the upper levels of the trees do not exclude, by dual traversal from the roots.

        A level is a table of nodes, and the pairs of a level are joined with the children of
        both sides; a join key (h, node) has FAN children.
        """
        scratch, name = self.scratch, f"nodes-{turn}"
        # Chunks are numbered by place within their shingle, so FAN of them in a row make a node.
        chunks = wide.select("h", "chunk").distinct()
        places = Window.partitionBy("h").orderBy("chunk")
        numbered = scratch.write(chunks.withColumn("node", F.row_number().over(places).cast("long") - 1), f"{name}-chunks")
        rows = wide.join(numbered, ["h", "chunk"]).select("h", "node", "n", "label", "bits")
        made = rows.repartition(self.parts, "h", "node").sortWithinPartitions("h", "node").mapInArrow(trimmed(_nodes_of(True)), _NODE)
        levels = [scratch.write(made, f"{name}-0")]
        widest = levels[0].agg(F.max("node")).first()[0]
        while widest:
            widest //= FAN
            above = levels[-1].withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
            made = above.repartition(self.parts, "h", "node").sortWithinPartitions("h", "node").mapInArrow(trimmed(_nodes_of(False)), _NODE)
            levels.append(scratch.write(made, f"{name}-{len(levels)}"))
        pairs = levels[-1].filter("first < last").select("h", F.col("node").alias("one"), F.col("node").alias("two"))
        for depth in range(len(levels) - 2, -1, -1):
            child = levels[depth].withColumn("parent", F.floor(F.col("node") / FAN).cast("long"))
            side = lambda s, p: child.select(F.col("h").alias(f"{s}_h"), F.col("parent").alias(f"{s}_parent"), F.col("node").alias(p), *[F.col(c).alias(f"{s}_{c}") for c in (*_RANGES, "bits")])  # noqa: B023, E731
            above = pairs.withColumnsRenamed({"one": "above_one", "two": "above_two"})
            grown = above.join(side("x", "one"), (F.col("h") == F.col("x_h")) & (F.col("above_one") == F.col("x_parent")))
            grown = grown.join(side("y", "two"), (F.col("h") == F.col("y_h")) & (F.col("above_two") == F.col("y_parent"))).filter("one <= two")
            columns = ["h", "one", "two", *[f"{s}_{c}" for s in "xy" for c in (*_RANGES, "bits")]]
            pairs = scratch.write(grown.select(columns).mapInArrow(trimmed(_node_pairs), "h long, one long, two long"), f"{name}-pairs-{depth}")
        chunk = lambda s: numbered.select(F.col("h").alias(f"{s}_h"), F.col("node").alias(f"{s}_node"), F.col("chunk").alias(f"{s}_chunk"))
        both = pairs.join(chunk("x"), (F.col("h") == F.col("x_h")) & (F.col("one") == F.col("x_node"))).join(chunk("y"), (F.col("h") == F.col("y_h")) & (F.col("two") == F.col("y_node")))
        return scratch.write(both.select("h", F.col("x_chunk").alias("one"), F.col("y_chunk").alias("two")), f"{name}-pairs")

    def _candidates(self, leaves: DataFrame, labels: DataFrame | None, turn: int | None) -> DataFrame:
        """Pairs that the trees cannot exclude, among documents not connected so far."""
        rows = self._labelled(leaves, labels)
        names = ["h", "one", "two", "n", "pos", "class_id", "label", "chunk", "bits"]
        # Blocks of one chunk are a tree that meets itself; others need the upper levels.
        found = rows.filter("not wide").withColumns({"one": F.col("chunk"), "two": F.col("chunk")}).select(names)
        if leaves.filter("wide").limit(1).count():
            wide = self.scratch.write(rows.filter("wide").drop("wide"), f"wide-{turn}")
            pairs = self._chunk_pairs(wide, turn)
            sides = pairs.select("h", "one", "two", F.col("one").alias("chunk")).union(pairs.filter("one <> two").select("h", "one", "two", F.col("two").alias("chunk")))
            found = found.union(sides.join(wide, ["h", "chunk"]).select(names))
        return found.repartition(self.parts, "h", "one", "two").sortWithinPartitions("h", "one", "two", "n").mapInArrow(trimmed(_traversal(turn)), "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    return JaccardJoin(spark, docs).run()


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each component, the first with the least doc_id; all columns. Documents without words stay.

    Rows are told apart by doc_id and text, so repeated and null ids are rows of their own
    and every pass over ``docs`` decides alike; of rows equal in both any one stays.
    """
    surplus = JaccardJoin(spark, docs, digests=True).surplus()
    small = surplus.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then whole documents need no shuffle
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("own_id"), *digest_of("text"))

    def rows_of(table: DataFrame, how: str) -> DataFrame:
        table = table.select(F.col("doc_id").alias("gone_id"), *[F.col(name).alias(f"gone_{name}") for name in DIGEST])
        same = F.col("own_id").eqNullSafe(F.col("gone_id"))
        for name in DIGEST:
            same &= F.col(name) == F.col(f"gone_{name}")
        return keyed.join(F.broadcast(table) if small else table, same, how)

    single = rows_of(surplus, "left_anti")
    # Rows that are repeated as they are: partial aggregates keep one in each task before they meet.
    several = rows_of(surplus.filter("not all"), "left_semi").dropDuplicates(["own_id", *DIGEST])
    return single.union(several).select("doc.*")

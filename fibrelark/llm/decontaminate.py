"""Benchmark decontamination: CGK embedding, bit sampling over item-sized windows, exact edit verification.

Texts and items are compared as sequences of lower-cased words without punctuation; in
scripts that put no blanks between words each character is a word. An item leaks into a
document if some stretch of the document is within ``floor(0.2 * words of the item)``
word edits of it.

1. Windows. With at most k edits, the n - k words that stay fall into at most k + 1
   stretches, so one stretch has ceil((n - k) / (k + 1)) words or more: three, but two
   for an item of five words. Every three (two) words in a row of a document that an
   item also has place an item-sized window; no match can be missed, and nothing else
   is embedded.
   An item of more than SCREENED_WORDS words is cut into even slices, each with its own
   windows: of all edits of a match, one slice has no more than its own limit, as the
   limits of the slices and one add up to more than the item's.
2. The CGK random walk reads a window under a shared random source and turns its edit
   distance to a slice into a Hamming distance. Each of REPEATS tables samples a few
   positions of one of several embeddings; the places depend on the number of words
   only, so the items of a size are indexed by their buckets once, and a window is
   looked up in all tables of its size. Items in one of its buckets are candidates.
   BITS and REPEATS are chosen so that a window at the edit limit is found with a
   probability over 0.99 (measured in the tests) for slices of all sizes; items of up to
   four words have no edits, and equal windows share every bucket.
3. Candidates are verified by the exact edit distance with free ends: bit-parallel for
   the edits and the end, then a band of the plain table for the start.

Items are indexed on the driver in blocks of BLOCK_WORDS words at most, which bounds an
index (about 20 MB), and broadcast; each block is one pass over the documents, whose
texts are never shuffled.

Defined results: null or empty texts and items match nothing; very long texts and
items are searched whole; items of one or two words are searched as others are, unless
``min_words`` leaves them out (a common word is little evidence of a leak); a null
doc_id or item_id is carried; repeated rows match each; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibrelark.llm.common import batches, mix64, text_column

MOST_EDITS = 0.2
MIN_WORDS = 1  # shorter items are left out
SEED_WORDS = 3
PAIR_SEEDED = 5  # words of the items that a match need not share three words in a row with
WALKS = 8
REPEATS = 192
BITS = 4
SCREENED_WORDS = 48
BLOCK_WORDS = 200_000
SLICE = 512  # windows embedded at once, which bounds a worker's memory
# Thai and Lao, Myanmar, Khmer, New Tai Lue, Tai Tham, kana, Han.
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1980-\u19df\u1a20-\u1aaf\u3005-\u3007\u3021-\u3029\u3031-\u303c\u3040-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U0003ffff"
)
_WORD = re.compile(r"\w+")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD_OR_CHARACTER = re.compile(f"[^\\W{_UNSPACED}]+|(?=\\w)[{_UNSPACED}]")


def words_of(text: str) -> list[str]:
    return (_WORD_OR_CHARACTER if _ANY_UNSPACED.search(text) else _WORD).findall(text.lower())


def edit_limit(n: int) -> int:
    return int(MOST_EDITS * n)


def least_edits(item: list[int], stretch: list[int]) -> tuple[int, int]:
    """Least word edits between the item and any part of the stretch, and the first end of such a part."""
    # Myers' bit vectors: bit i tells how the column's cells i and i + 1 differ. Starting anywhere is free.
    n = len(item)
    full, last = (1 << n) - 1, 1 << (n - 1)
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    up, down, edits = full, 0, n
    best = (n, 0)
    for j, word in enumerate(stretch, 1):
        same = masks.get(word, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rises = down | (full & ~(diagonal | up))
        falls = up & diagonal
        if rises & last:
            edits += 1
        elif falls & last:
            edits -= 1
            if edits < best[0]:
                best = (edits, j)
        rises = rises << 1 & full
        falls = falls << 1 & full
        up = falls | (full & ~((same | down) | rises))
        down = rises & (same | down)
    return best


def edit_distance_within(item: list[int], stretch: list[int], limit: int) -> tuple[int, int, int] | None:
    """Least word edits between the item and any part of the stretch, with the part's start and end; None above the limit."""
    edits, end = least_edits(item, stretch)
    if edits > limit:
        return None
    # Row by item word, where a cell can be on a path to the end: (edits, start of the part).
    n = len(item)
    never = (n + edits + 1, 0)
    shift = end - n
    row = {j: (0, j) for j in range(max(0, shift - edits), min(end, shift + edits) + 1)}
    for i, word in enumerate(item, 1):
        above, row = row, {}
        for j in range(max(0, shift - edits + i), min(end, shift + edits + i) + 1):
            if j == 0:
                row[0] = (i, 0)
                continue
            best = above.get(j - 1, never)
            if word != stretch[j - 1]:
                best = (best[0] + 1, best[1])
            for over in (above.get(j, never), row.get(j - 1, never)):
                if over[0] + 1 < best[0]:
                    best = (over[0] + 1, over[1])
            row[j] = best
    return (edits, row[end][1], end)


def _sliced(own: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """An item in even slices of at most SCREENED_WORDS words, with their places."""
    parts = np.array_split(own, -(-len(own) // SCREENED_WORDS))
    return list(zip(np.cumsum([0, *(len(p) for p in parts[:-1])]).tolist(), parts, strict=True))


def _seed_words(n: int) -> int:
    """How many words in a row any match of so many words must share."""
    return min(n, SEED_WORDS - 1 if n == PAIR_SEEDED else SEED_WORDS)


class Walks:
    """The shared random source of the embeddings: for each walk and step, which words move the reader on."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.steps = rng.integers(1, 1 << 62, size=(WALKS, 2 * SCREENED_WORDS), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.picks = rng.random((WALKS, REPEATS // WALKS, BITS))
        self.factors = rng.integers(1, 1 << 62, size=BITS, dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def embed(self, windows: np.ndarray, length: int) -> np.ndarray:
        """CGK of each row of word ids under every walk, ``length`` steps; past its end a row gives 0."""
        n, m = windows.shape
        # All walks go in step: row r of walk w is at r * WALKS + w.
        padded = np.concatenate([windows, np.zeros((n, 1), np.int64)], axis=1).reshape(-1)
        base = np.repeat(np.arange(n) * (m + 1), WALKS)
        out = np.zeros((length, n * WALKS), np.int64)
        at = np.zeros(n * WALKS, np.int64)
        for step in range(length):
            word = padded[base + np.minimum(at, m)]
            out[step] = word
            # A bit of the word under this step's hash says whether the reader moves.
            mixed = (word.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.tile(self.steps[:, step], n)
            at += ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        return out.reshape(length, n, WALKS)

    def buckets(self, windows: np.ndarray) -> np.ndarray:
        """The bucket of each window in every table. Places lie where a walk over so many words is on average."""
        n, size = windows.shape
        embedded = self.embed(windows, 2 * size)
        places = (self.picks * (2 * size)).astype(np.int64)
        out = np.empty((n, WALKS, REPEATS // WALKS), np.uint64)
        for w in range(WALKS):
            seen = embedded[places[w], :, w].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)  # table, sample, window
            out[:, w] = (seen * self.factors[None, :, None]).sum(axis=1, dtype=np.uint64).T
        # A table's number is part of its buckets' names.
        return mix64(out.reshape(n, REPEATS) ^ mix64(np.arange(1, REPEATS + 1, dtype=np.uint64)))


class Items:
    """A block of benchmark items as word ids, in slices: the places of every three words in a row, and the buckets of each size."""

    def __init__(self, items: list[tuple[int | None, str]], min_words: int = MIN_WORDS) -> None:
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, text in items:
            words = words_of(text)
            if len(words) < max(1, min_words):
                continue
            own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int64)
            self.items.append((item_id, own))
        # Item, first word in it, words.
        self.slices = [(k, int(at), part) for k, (_, own) in enumerate(self.items) for at, part in _sliced(own)]
        self.walks = Walks()
        self.index = {n: self._indexed(n) for n in {len(part) for _, _, part in self.slices}}
        self.seeds = [self._seeds(width) for width in range(SEED_WORDS, 0, -1)]

    def _indexed(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the slices of n words in order, and whose each is."""
        of_size = np.array([k for k, (_, _, own) in enumerate(self.slices) if len(own) == n])
        buckets = np.concatenate([self.walks.buckets(np.stack([self.slices[k][2] for k in of_size[i : i + SLICE]])) for i in range(0, len(of_size), SLICE)])
        order = np.argsort(buckets.reshape(-1), kind="stable")
        return buckets.reshape(-1)[order], np.repeat(of_size, REPEATS)[order].astype(np.int32)

    def looked_up(self, windows: np.ndarray) -> np.ndarray:
        """Distinct (slice, row of ``windows``) that share a bucket in any table."""
        buckets, whose = self.index[windows.shape[1]]
        found = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(windows), SLICE):
            keys = self.walks.buckets(windows[i : i + SLICE]).reshape(-1)
            first = np.searchsorted(buckets, keys, "left")
            hit = np.flatnonzero(buckets[np.minimum(first, len(buckets) - 1)] == keys)
            many = np.searchsorted(buckets, keys[hit], "right") - first[hit]
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            items = whose[np.repeat(first[hit], many) + offset]
            found.append(np.stack([items, np.repeat(hit // REPEATS, many) + i], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def _seeds(self, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Of the slices that so many words in a row seed: width, codes in order, and the slice and place of each."""
        seeds = [(int(c), k, at) for k, (_, _, own) in enumerate(self.slices) if _seed_words(len(own)) == width for at, c in enumerate(self.codes(own, width))]
        codes, items, places = np.array(sorted(seeds), np.int64).reshape(-1, 3).T
        return width, codes, items, places

    def codes(self, words: np.ndarray, width: int) -> np.ndarray:
        """A number for each so many words in a row; -1 if one of them is in no item."""
        n = max(0, len(words) - width + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(width):
            part = words[k : k + n]
            out = out * np.int64(len(self.ids) + 1) + part
            known &= part > 0
        return np.where(known, out, -1)

    def windows(self, words: np.ndarray) -> np.ndarray:
        """Distinct (slice, start) of windows of its size that a seed places in the document."""
        found = np.concatenate([self._placed(words, *seeds) for seeds in self.seeds])
        return np.unique(found, axis=0) if len(found) else found

    def _placed(self, words: np.ndarray, width: int, seed_codes: np.ndarray, seed_items: np.ndarray, seed_places: np.ndarray) -> np.ndarray:
        none = np.zeros((0, 2), np.int64)
        if not len(seed_codes):
            return none
        codes = self.codes(words, width)
        places = np.flatnonzero(codes >= 0)
        first = np.searchsorted(seed_codes, codes[places], "left")
        many = np.searchsorted(seed_codes, codes[places], "right") - first
        places, first, many = places[many > 0], first[many > 0], many[many > 0]
        if not len(places):
            return none
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        seeds = np.repeat(first, many) + offset
        return np.stack([seed_items[seeds], np.repeat(places, many) - seed_places[seeds]], axis=1)


def joined(starts: np.ndarray, n: int, limit: int, size: int) -> list[tuple[int, int]]:
    """The stretches that windows of n words at these ascending starts cover, with ``limit`` words on both sides."""
    out: list[tuple[int, int]] = []
    for start in starts.tolist():
        low, high = max(0, start - limit), min(size, start + n + limit)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def candidates(items: Items, words: np.ndarray) -> dict[int, np.ndarray]:
    """Starts of candidate windows by item: where a slice's window is in one of the slice's buckets."""
    placed = items.windows(words)
    by_size: dict[int, list[np.ndarray]] = {}
    for k in np.unique(placed[:, 0]) if len(placed) else []:
        own = items.slices[k][2]
        n = len(own)
        limit = edit_limit(n)
        starts = placed[placed[:, 0] == k, 1]
        near = starts[(starts > -n) & (starts < len(words))]
        # Too few words of the slice within reach: no edit script can be short enough.
        members = np.concatenate([[0], np.cumsum(np.isin(words, own))])
        near = near[members[np.minimum(near + n + limit, len(words))] - members[np.maximum(near - limit, 0)] >= n - limit]
        if len(near):
            by_size.setdefault(n, []).append(near)
    found: dict[int, list[np.ndarray]] = {}
    for n, lists in by_size.items():
        starts = np.unique(np.concatenate(lists))
        at = starts[:, None] + np.arange(n)[None, :]
        rows = np.where((at >= 0) & (at < len(words)), words[np.clip(at, 0, len(words) - 1)], 0)
        pairs = items.looked_up(np.where(rows == 0, -1, rows))  # a foreign word is no end of text
        for k in np.unique(pairs[:, 0]):
            item, first, _ = items.slices[k]
            found.setdefault(item, []).append(starts[pairs[pairs[:, 0] == k, 1]] - first)
    return {item: np.unique(np.concatenate(lists)) for item, lists in found.items()}


def search(items: Items, text: str) -> list[tuple[int | None, int, int, int, int]]:
    """(item_id, words of the item, edits, first word, end) of each item that leaks into the text, at its best place."""
    words = np.array([items.ids.get(w, 0) for w in words_of(text)], np.int64)
    out = []
    # Words that no item has are all alike to the distance: none of them equals an item's word.
    listed: list[int] | None = None
    for k, near in sorted(candidates(items, words).items()):
        listed = words.tolist() if listed is None else listed
        item_id, own = items.items[k]
        n = len(own)
        limit = edit_limit(n)
        best = None
        # Windows that overlap are one stretch, so each word is read once.
        for low, high in joined(near[(near > -n - limit) & (near < len(words) + limit)], n, limit, len(words)):
            found = edit_distance_within(own.tolist(), listed[low:high], limit if best is None else best[0] - 1)
            if found:
                best = (found[0], low + found[1], low + found[2])
            if best and best[0] == 0:
                break
        if best:
            out.append((item_id, n, *best))
    return out


_LEAKS = "row_id long, doc_id long, item_id long, item_words long, edits long, first_word long, end_word long"


def _blocks_of(spark: SparkSession, benchmark: DataFrame) -> list[DataFrame]:
    """The items in blocks of about BLOCK_WORDS words, dealt by a hash; one block for a usual benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 4
    n = int(words // BLOCK_WORDS) + 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _indexed(spark: SparkSession, block: DataFrame, min_words: int):  # noqa: ANN202
    """A block's index, built once and broadcast."""
    rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return spark.sparkContext.broadcast(Items(rows, min_words))


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, row_id: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs of a document and an item that leaks into it: doc_id, item_id, item_words, edits, first_word, end_word."""
    docs = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for block in _blocks_of(spark, benchmark):
        shared = _indexed(spark, block, min_words)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            items = shared.value
            for batch in batches(parts):
                out: list[tuple] = []
                for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_column(batch, "text"), strict=True):
                    out += [(row, doc_id, *leak) for leak in search(items, text)]
                columns = zip(*out, strict=True) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _LEAKS.split(", ")])

        found.append(docs.mapInArrow(run, _LEAKS))
    leaks = reduce(DataFrame.union, found)
    return leaks if row_id else leaks.drop("row_id")


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that no item leaks into, with all their columns. Each row is decided by its own text."""
    for block in _blocks_of(spark, benchmark):
        shared = _indexed(spark, block, min_words)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            items = shared.value
            for batch in batches(parts):
                yield batch.filter(pa.array([not search(items, text) for text in text_column(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

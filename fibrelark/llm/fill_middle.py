"""Fill-in-the-middle documents, cut between lines by arithmetic on big integers.

A text's bytes are translated into digits and read as one integer: bit i of a class mask says
whether byte i is of the class. The line ends, shifted by one, are the line starts; counting
their bits gives the number n of units (lines). The place of the unit with a given rank is
found by recursive halving: of each half the bits are counted, and the search goes on in one,
so that a text of any length costs a few passes over a mask of an eighth of its size. The same
masks count the code points of a part.

A document's four draws come from a hash of seed and doc_id: two ranks out of n + 1, whose
smaller one ends the prefix and whose larger one ends the middle, whether it is rearranged at
all, and in which of two orders. ``restore`` rebuilds the text from output and form alone.

Defined results: a null text is an empty one; an empty text, one that holds a mark, and one left
out by ``rate`` stay plain (the output is the text, no part has a length); very long texts are
cut whole; a null doc_id is hashed as an empty id; repeated rows give the same output each; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelark.llm.common import batches, bytes_column, own_columns, trimmed

# Fixed values of the contract: the marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Bytes of output in one batch that a task hands back; a longer text is a batch of its own.
HANDED = 8 << 20

_ENDS = bytes(49 if b == 10 else 48 for b in range(256))
_LEADS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def mask(text: bytes, classes: bytes) -> int:
    """The integer whose bit i is set where byte i of the text is of the class."""
    return int(text[::-1].translate(classes), 2) if text else 0


def ones_before(bits: int, place: int) -> int:
    """How many bits are set below a place."""
    return (bits & ((1 << place) - 1)).bit_count()


def ranked_bit(bits: int, rank: int) -> int:
    """The place of the set bit with this rank, counted from 0; there must be one."""
    place, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        held = low.bit_count()
        if rank < held:
            bits, width = low, half
        else:
            bits, place, rank, width = bits >> half, place + half, rank - held, width - half
    return place


class Lines:
    """The units of a text: lines with their ends, the last one with or without."""

    __slots__ = ("text", "starts", "n")

    def __init__(self, text: bytes) -> None:
        self.text = text
        first = 1 if text else 0
        # A line starts at the text's start and after each line end, but not behind the last byte.
        self.starts = (mask(text, _ENDS) << 1 | first) & ((1 << len(text)) - 1)
        self.n = self.starts.bit_count()

    def end_of(self, units: int) -> int:
        """The byte place behind the first so many units."""
        return len(self.text) if units >= self.n else ranked_bit(self.starts, units)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    a, b, c, d = (int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))
    return a, b, c, d


def rearrange(doc_id: int | None, text: bytes, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and the output of one document."""
    lines = Lines(text)
    first, second, kept, order = draws(doc_id, seed)
    if not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or kept % 100 >= rate:
        return lines.n, "plain", None, None, text
    low, high = sorted((first % (lines.n + 1), second % (lines.n + 1)))
    a, b = lines.end_of(low), lines.end_of(high)
    leads = mask(text, _LEADS)
    before = ones_before(leads, a)
    prefix, middle, suffix = PREFIX.encode() + text[:a], MIDDLE.encode() + text[a:b], SUFFIX.encode() + text[b:]
    swapped = order % 100 < spm
    output = suffix + prefix + middle if swapped else prefix + suffix + middle
    return lines.n, "spm" if swapped else "psm", before, ones_before(leads, b) - before, output


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output for every row; no exchange.

    ``rate`` is the share of documents to rearrange and ``spm`` that of the second order
    among them, both out of 100.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary()]

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
        columns[-1] = columns[-1].cast(pa.large_string()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    @trimmed
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_column(batch, "text"), strict=True):
                rows.append((doc_id, *rearrange(doc_id, text, seed, rate, spm)))
                size += len(text)
                if size >= HANDED:
                    yield handed(rows)
                    rows, size = [], 0
            if rows:
                yield handed(rows)

    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output came from, as an expression over output and form alone.

    Texts that hold a mark are plain, so in the others each mark's first place behind the
    one before is the real one.
    """

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        left = F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
        rest = F.substr(output, F.length(left) + F.lit(len(first) + len(second) + 1))
        right = F.substring_index(rest, MIDDLE, 1)
        return left, right, F.substr(rest, F.length(right) + F.lit(len(MIDDLE) + 1))

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)

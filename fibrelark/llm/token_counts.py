"""Token counts with the whole-token shortcut.

Offline, on the driver, every string of the vocabulary is encoded alone; those that
give just one token are proven whole tokens. Workers cut texts into pre-tokens, look
these up among the proven strings and among pre-tokens merged before, and send only
the rest to the library, many at a time: each pre-token's last token carries the mark
of a word end, so one list of ids holds the counts of all.

Cutting follows the library's pattern over characters whose class, case and
composition no version of Unicode disputes (ASCII and Latin letters up to U+017F).
A stretch between blanks with any other character, or with what might be a special
string, goes to the library whole. The pre-tokenizer never joins characters across
white space, and the normalizer composes none across it, so the counts of the parts
add up to the count of the text.

Defined results: a null or empty text has 0 bytes and 0 tokens; very long texts are
counted whole; doc_id may be null or repeat; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fibrelark.llm.common import batches, text_column

# Pre-tokens remembered by a worker, and the longest that is; both bound its memory.
REMEMBERED = 400_000
LONGEST = 64
# Characters of text that a worker cuts at once.
STRETCH = 1 << 20
# Characters that are sent to the library in one string.
SENT = 1 << 18
WORD_END = "</w>"

# Latin letters from U+00C0 to U+017F that have one lower-case letter there: all but the dotted
# capital I; the multiplication and division signs are no letters.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_BLANK = "\\x09-\\x0d\\x20"
_OTHER = re.compile(f"[^\\x00-\\x7f{_LATIN}]|[\\x1c-\\x1f]|<\\|")
_CLEAR = re.compile(f"[^{_BLANK}]+")
# Fixed value: the pattern of the vocabulary's pre-tokenizer, over those characters.
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^{_BLANK}a-z0-9{_LATIN}]+")


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


def proven_whole(tokenizer_path: str) -> list[bytes]:
    """Pre-tokens that the library encodes alone as one token, in UTF-8."""
    tokenizer = Tokenizer.from_file(tokenizer_path)
    letters = byte_letters()
    found = set()
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        spelt = entry.removesuffix(WORD_END)
        if any(c not in letters for c in spelt):
            continue
        try:
            word = bytes(letters[c] for c in spelt).decode()
        except UnicodeDecodeError:
            continue
        if len(word) <= LONGEST and not _OTHER.search(word) and _PRE_TOKEN.findall(word.lower()) == [word]:
            found.add(word)
    words = sorted(found)
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return [w.encode() for w, e in zip(words, encoded, strict=True) if len(e.ids) == 1]


class PieceCounter:
    """Counts tokens in one worker process."""

    def __init__(self, tokenizer_path: str, whole: list[bytes]) -> None:
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for entry, i in vocabulary.items() if entry.endswith(WORD_END)]] = True
        self.whole = dict.fromkeys([w.decode() for w in whole], 1)
        self.known = dict(self.whole)
        self.odd: dict[str, int] = {}  # stretches that the library counts whole

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= STRETCH:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            odd = 0
            if _OTHER.search(text):
                clear = []
                for piece in _CLEAR.findall(text):
                    if _OTHER.search(piece):
                        odd += self._odd(piece)
                    else:
                        clear.append(piece)
                text = " ".join(clear)
            cut.append(_PRE_TOKEN.findall(text.lower()))
            extra.append(odd)
        known = self.known
        missing = list(set().union(*cut).difference(known))
        if missing:
            known.update(self._merge(missing))
        out = [n + sum(map(known.__getitem__, words)) for words, n in zip(cut, extra, strict=True)]
        if len(known) > REMEMBERED:
            self.known = dict(self.whole)
        else:
            for word in missing:
                if len(word) > LONGEST:
                    del known[word]
        return out

    def _merge(self, words: list[str]) -> dict[str, int]:
        """Tokens of each pre-token; the words go to the library in a few long strings."""
        counts: list[np.ndarray] = []
        start = size = 0
        for k, word in enumerate(words):
            size += len(word) + 1
            if size >= SENT or k == len(words) - 1:
                ids = np.asarray(self.tokenizer.encode(" ".join(words[start : k + 1]), add_special_tokens=False).ids)
                counts.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
                start, size = k + 1, 0
        return dict(zip(words, np.concatenate(counts).tolist(), strict=True))

    def _odd(self, piece: str) -> int:
        n = self.odd.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(self.odd) >= REMEMBERED // 4:
                self.odd.clear()
            if len(piece) <= LONGEST:
                self.odd[piece] = n
        return n


_COUNTERS: dict[str, PieceCounter] = {}


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; no exchange.

    The proven strings are broadcast: their number is bounded by the vocabulary.
    """
    whole = spark.sparkContext.broadcast(proven_whole(tokenizer_path))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = PieceCounter(tokenizer_path, whole.value)
        counter = _COUNTERS[tokenizer_path]
        for batch in batches(parts):
            counts = counter.count(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

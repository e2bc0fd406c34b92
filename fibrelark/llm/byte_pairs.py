"""Token ids of many texts at once, with a byte-level tokenizer file.

Pre-tokens do not depend on each other, so each distinct one is merged once and looked up
afterwards: texts are cut into pre-tokens by masks over whole arrays of bytes, and a hash table
of arrays, keyed by a pre-token's bytes themselves, gives all their ids together. Many are merged
at a time, by a faster library over the same vocabulary, which joins any two neighbours that make
an entry where the file joins only listed pairs. The two agree if every entry encodes alone as
itself, as the last pair joined within an entry's span is then the listed one; this is proven
on the driver, and if it does not hold the file's own library merges.

Cutting follows the library's pattern over characters whose class no version of Unicode
disputes (ASCII and Latin letters up to U+017F). Stretches with other characters, or with what
might be a special string, are cut at white space behind an undisputed character, where the
pattern always ends a pre-token, and go to the library whole.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from fibrelark.llm.common import mix64
from fibrelark.llm.token_counts import byte_letters

# Pre-tokens and ids that a worker remembers, and bytes of text that it cuts at once; all bound its memory.
REMEMBERED = 1 << 20
IDS = 1 << 23
STRETCH = 1 << 21
# Bytes of a pre-token that the table holds; longer ones, and stretches for the library, are in a dict up to LONGEST.
HELD = 16
LONGEST = 64

_WHITE = b"\t\n\x0b\x0c\r "
_END, _BLANK, _LETTER, _DIGIT, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(_WHITE)] = _BLANK
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC6)]] = _LETTER  # also both bytes of the Latin letters
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[0xFF] = _END  # in no UTF-8 text: parts two texts

# Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# NUL could not be told from the end of a short pre-token in the table.
_PLAIN = bytes([*range(1, 0x1C), *range(0x20, 0xC2), 0xC3, 0xC4, 0xC5])
_ODD = re.compile(rb"[\x00\x1c-\x1f\xc2\xc6-\xff]|\xc3[\x97\xb7]|<\|")
_CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_SAFE = re.compile(rb"(?<=[!-~])[\t-\r ]")
_CLEAR_END = re.compile(rb"[!-~]\Z|[\xc3-\xc5][\x80-\xbf]\Z")
_BLANKS = frozenset(bytes([c]) for c in _WHITE)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def is_odd(text: bytes) -> bool:
    return bool(text.translate(None, _PLAIN)) or b"<|" in text or (not text.isascii() and (b"\xc3\x97" in text or b"\xc3\xb7" in text))


def starts(b: np.ndarray) -> np.ndarray:
    """Where a pre-token starts, over bytes of clear texts that each end with 0xFF; at least two of those come last."""
    kind = _CLASS[b]
    out = np.ones(len(b), bool)
    out[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    # The last blank before a word is a pre-token of its own, or the word's first character if it is a space.
    word = np.flatnonzero(out[1:] & (kind[:-1] == _BLANK) & (kind[1:] != _END)) + 1
    out[word - 1] = True
    out[word[b[word - 1] == 32]] = False
    # An apostrophe that starts a pre-token takes the letters of a contraction.
    mark = np.flatnonzero(out & (b == 39))
    one, two = b[mark + 1], b[np.minimum(mark + 2, len(b) - 1)]
    short = mark[np.isin(one, list(b"stmd"))]
    long = mark[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))]
    out[short + 1], out[short + 2] = False, True
    out[long + 1], out[long + 3] = False, True
    return out


def _is_text(word: bytes) -> bool:
    try:
        word.decode()
    except UnicodeDecodeError:
        return False
    return True


def _cut_alone(word: bytes) -> list[int]:
    b = np.frombuffer(word + b"\xff\xff\xff", np.uint8)
    return np.flatnonzero(starts(b)[: len(word)]).tolist()


class Vocabulary(NamedTuple):
    """What workers need of a tokenizer file; its size is bounded by the vocabulary's."""

    known_pattern: bool
    width: int
    ranks: dict[bytes, int] | None


def read_vocabulary(tokenizer_path: str) -> Vocabulary:
    """Reads the file once, on the driver, and proves that the faster library may merge."""
    tokenizer = Tokenizer.from_file(tokenizer_path)
    setting = json.loads(tokenizer.to_str())
    cutter = setting["pre_tokenizer"] or {}
    # Other tokenizers cut otherwise: the library then encodes the texts whole.
    known = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space") and not setting["normalizer"]
    width = 2 if max(tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
    return Vocabulary(bool(known), width, _proven(tokenizer, setting["model"]["vocab"]) if known else None)


def _proven(tokenizer: Tokenizer, vocabulary: dict[str, int]) -> dict[bytes, int] | None:
    """The entries as bytes, if each that a text can hold alone encodes as itself."""
    letters = byte_letters()
    added = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(letters[c] for c in entry): k for entry, k in vocabulary.items() if all(c in letters for c in entry) and entry not in added}
    if len(ranks) < len(vocabulary.keys() - added) or not all(bytes([b]) in ranks for b in range(256)):
        return None
    whole = [(w, k) for w, k in ranks.items() if _is_text(w)]
    own = tokenizer.encode_batch([w.decode() for w, _ in whole], add_special_tokens=False)
    # An entry over two pre-tokens can never be met whole; any other must come out as itself.
    bad = (w for (w, k), e in zip(whole, own, strict=True) if e.ids != [k] and (len(e.ids) == 1 or len(_cut_alone(w)) == 1))
    return None if any(True for _ in bad) else ranks


class Encoder:
    """Encodes texts in one worker process."""

    def __init__(self, tokenizer_path: str, vocabulary: Vocabulary | None = None) -> None:
        vocabulary = vocabulary or read_vocabulary(tokenizer_path)
        self.path, self.known_pattern, self.kind = tokenizer_path, vocabulary.known_pattern, np.dtype(f"<u{vocabulary.width}")
        self.merges = tiktoken.Encoding("entries", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}) if vocabulary.ranks else None
        self.tokenizer: Tokenizer | None = None
        self._forget()

    def _library(self, texts: list[str]) -> list[list[int]]:
        if self.tokenizer is None:  # loaded where a text needs it
            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        size = 2 * REMEMBERED
        self.low, self.high, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)
        self.long: dict[bytes, int] = {}
        self.odd: dict[bytes, np.ndarray] = {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= STRETCH:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        parts = [self._parts(text) for text in texts]
        found: list[np.ndarray] = []
        clear, size = [], 0
        for part, odd in (p for text in parts for p in text):
            if odd:
                found += self._clear(clear)
                clear, size = [], 0
                found.append(self._whole(part))
            else:
                clear.append(part)
                size += len(part)
                if size >= STRETCH:
                    found += self._clear(clear)
                    clear, size = [], 0
        found += self._clear(clear)
        out, at = [], 0
        for text in parts:
            of = found[at : at + len(text)]
            at += len(text)
            out.append(of[0] if len(of) == 1 else np.concatenate(of) if of else np.zeros(0, self.kind))
        return out

    def _parts(self, text: bytes) -> list[tuple[bytes, bool]]:
        """The text in stretches, each with whether the library must encode it whole."""
        if not text:
            return []
        if not self.known_pattern:
            return [(text, True)]
        if not is_odd(text):
            return [(part, False) for part in self._cut(text)]
        out: list[tuple[bytes, bool]] = []
        begin, odd, joined = 0, False, False
        for chunk in _CHUNK.finditer(text):
            now = bool(_ODD.search(text, chunk.start(), chunk.end()))
            # Behind a disputed character a blank may belong to it.
            if chunk.start() and (now or joined) != odd:
                out.append((text[begin : chunk.start()], odd))
                begin = chunk.start()
            odd = now or joined
            joined = now and not _CLEAR_END.search(text, max(chunk.start(), chunk.end() - 2), chunk.end())
        out.append((text[begin:], odd))
        return [(part, o) for whole, o in out for part in ([whole] if o else self._cut(whole))]

    def _cut(self, text: bytes) -> list[bytes]:
        """A long text in pieces that end with a pre-token."""
        out, begin = [], 0
        while len(text) - begin > STRETCH:
            place = _SAFE.search(text, begin + STRETCH // 2)
            if place is None:
                break
            out.append(text[begin : place.start()])
            begin = place.start()
        return [*out, text[begin:]]

    def _whole(self, part: bytes) -> np.ndarray:
        ids = self.odd.get(part)
        if ids is None:
            ids = np.array(self._library([part.decode()])[0], self.kind)
            if len(part) <= LONGEST:
                if len(self.odd) >= REMEMBERED // 8:
                    self.odd.clear()
                self.odd[part] = ids
        return ids

    def _clear(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts without odd characters."""
        if not parts:
            return []
        data = b"\xff".join(parts) + b"\xff" * (HELD + 2)
        b = np.frombuffer(data, np.uint8)[: len(data) - HELD]
        at = np.flatnonzero(starts(b))
        size = np.diff(at, append=len(b))
        ends = b[at] == 0xFF
        of_part = np.cumsum(ends)[~ends]
        at, size = at[~ends], size[~ends]
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low = eight[at] & _MASKS[np.minimum(size, 8)]
        high = eight[at + 8] & _MASKS[np.clip(size - 8, 0, 8)]
        entries = self._find(low, high)
        entries[size > HELD] = -1
        short = np.flatnonzero((entries < 0) & (size <= HELD))
        if len(short):
            # One of each distinct pre-token.
            order = short[np.lexsort((high[short], low[short]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            new = order[first]
            made = self._remember(*self._merge([data[s : s + n] for s, n in zip(at[new].tolist(), size[new].tolist(), strict=True)]))
            self._insert(low[new], high[new], made)
            entries[order] = made[np.cumsum(first) - 1]
        wide = np.flatnonzero(size > HELD).tolist()
        if wide:
            words = [data[at[k] : at[k] + size[k]] for k in wide]
            new = list(set(words).difference(self.long))
            usual, huge = [w for w in new if len(w) <= LONGEST], [w for w in new if len(w) > LONGEST]
            if usual:
                self.long.update(zip(usual, self._remember(*self._merge(usual)).tolist(), strict=True))
            if huge:  # of any length: left to the file's library
                own = self._library([w.decode() for w in huge])
                made = self._remember(np.array([i for ids in own for i in ids], self.kind), np.array([len(ids) for ids in own], np.int64))
                self.long.update(zip(huge, made.tolist(), strict=True))
            entries[wide] = [self.long[w] for w in words]
            for word in huge:
                del self.long[word]
        counts = self.count[entries]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begin[entries] - ends + counts, counts) + np.arange(total)]
        sizes = np.bincount(of_part, counts, minlength=len(parts)).astype(np.int64) if total else np.zeros(len(parts), np.int64)
        if len(self.count) > REMEMBERED or len(self.ids) > IDS:
            self._forget()
        return np.split(ids, np.cumsum(sizes)[:-1])

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens, one after the other, and how many each has."""
        if self.merges is None:
            own = self._library([w.decode() for w in words])
            return np.array([i for ids in own for i in ids], self.kind), np.array([len(ids) for ids in own], np.int64)
        # Many in one string, parted by line ends, which no pre-token holds that ends otherwise.
        lines = [w for w in words if w[-1:] not in _BLANKS]
        counts = np.zeros(len(words), np.int64)
        blank = np.fromiter((w[-1:] in _BLANKS for w in words), bool, len(words))
        ids = self.merges.encode_to_numpy(b"\n".join([*lines, b""]).decode(), disallowed_special=())
        stops = ids == self.merges.encode_ordinary("\n")[0]
        counts[~blank] = np.diff(np.flatnonzero(stops), prepend=-1) - 1
        ids = ids[~stops].astype(self.kind)
        if blank.any():
            own = [self.merges.encode_ordinary(words[k].decode()) for k in np.flatnonzero(blank)]
            counts[blank] = [len(x) for x in own]
            whole = np.empty(int(counts.sum()), self.kind)
            of_blank = np.repeat(blank, counts)
            whole[~of_blank], whole[of_blank] = ids, np.concatenate([np.array(x, self.kind) for x in own])
            ids = whole
        return ids, counts

    def _remember(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Entries of new words, given by all their ids and how many each has."""
        before = len(self.count)
        self.begin = np.concatenate([self.begin, np.cumsum(counts) - counts + len(self.ids)])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, ids.astype(self.kind)])
        return np.arange(before, before + len(counts))

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = mix64(low ^ (high * np.uint64(0x9E3779B97F4A7C15)))
        return (mixed & np.uint64(len(self.entry) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(low), -1, np.int64)
        slot, left = self._slots(low, high), np.arange(len(low))
        while len(left):
            s = slot[left]
            e = self.entry[s]
            same = (e >= 0) & (self.low[s] == low[left]) & (self.high[s] == high[left])
            out[left[same]] = e[same]
            left = left[(e >= 0) & ~same]
            slot[left] = (slot[left] + 1) & (len(self.entry) - 1)
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, made: np.ndarray) -> None:
        if len(self.count) >= len(self.entry) - len(self.entry) // 8:
            return  # full: these are merged again, and all is forgotten at the group's end
        slot, left = self._slots(low, high), np.arange(len(low))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            now = free[first]
            self.low[slot[now]], self.high[slot[now]], self.entry[slot[now]] = low[now], high[now], made[now]
            left = np.setdiff1d(left, now, assume_unique=True)
            taken = self.entry[slot[left]] >= 0
            slot[left[taken]] = (slot[left[taken]] + 1) & (len(self.entry) - 1)

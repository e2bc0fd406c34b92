"""Language-model scoring by subword lattice likelihood.

The strings of an existing subword vocabulary are the arcs of a lattice over each
word, and the probability of a word is the sum over all its segmentations, by
forward recursion in log space. The vocabulary's own scores are where the weights of the
arcs start: they order the strings, and the first weights fall with that order. EM_ROUNDS
rounds of expectation and maximisation then fit them to the training documents: every
distinct training word adds the expected number of uses of each string over all its
segmentations (forward and backward sums), times its count. A character outside the
vocabulary is spelt by its bytes. A document is its words and one end.

Corpus counts are a table of words. Words found in more than ``N / FREQUENT`` of all
training tokens number less than FREQUENT, so their counts are broadcast; the others
reach the documents by a shuffle join, whose large partitions the engine may split.

Defined results: a null or blank text is just its end; very long texts and words are
scored whole; a null doc_id counts as the text "" for the split; repeated rows are
documents each; an empty table gives an empty result; without training documents every
count is 0 and the weights are the first ones; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibrelark.llm.common import Scratch, batches, bytes_column

FOLDS, HELD_OUT = 5, 1
FREQUENT = 200_000
# Distinct words that a task counts before it passes them on.
HELD_WORDS = 400_000
# Weight of the vocabulary's own order against expected uses, in uses.
PRIOR = 2_000.0
EM_ROUNDS = 2
# Words up to this length are summed without logarithms when expectations are taken.
PLAIN = 40
SPACE = "▁"
END = -1  # the end's place among the piece ids of the counts


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their number in training documents (0 for words of others), and the ends under a null word."""

    def told(train: Counter, other: set[bytes], ends: int) -> pa.RecordBatch:
        words = [*train, *(other - train.keys()), None]
        n = np.zeros(len(words), np.int64)
        n[: len(train)] = list(train.values())
        n[-1] = ends
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n)], names=["word", "n"])

    train: Counter[bytes] = Counter()
    other: set[bytes] = set()
    ends = 0
    for batch in batches(parts):
        for doc_id, text in zip(batch.column(0).to_pylist(), bytes_column(batch, "text"), strict=True):
            if is_held_out(doc_id):
                other.update(tokens(text))
            else:
                ends += 1
                train.update(tokens(text))
            if len(train) + len(other) > HELD_WORDS:
                yield told(train, other, ends)
                train, other, ends = Counter(), set(), 0
    if train or other or ends:
        yield told(train, other, ends)


_PIECES: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _PIECES:
        _PIECES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PIECES[path]


# What follows a character: further characters, and the id (-1: no string ends here) and value of the string so far.
Trie = dict[str, tuple["Trie", int, float]]


def trie_of(strings: dict[str, tuple[int, float]]) -> Trie:
    root: Trie = {}
    for entry, (i, value) in sorted(strings.items()):  # beginnings come before what goes on from them
        here = root
        for k, character in enumerate(entry, 1):
            if character not in here:
                here[character] = ({}, i, value) if k == len(entry) else ({}, -1, 0.0)
            here = here[character][0]
    return root


Arc = tuple[int, int, int | list[int], float]  # start, end, string or bytes, log probability


def arcs_of(text: str, trie: Trie, bytes_of: list[tuple[int, float]]) -> list[Arc]:
    """The arcs of the lattice that can be reached, by start."""
    size = len(text)
    reached = [True] + [False] * size
    arcs: list[Arc] = []
    for i in range(size):
        if not reached[i]:
            continue
        single, here = False, trie
        for j in range(i, size):
            node = here.get(text[j])
            if node is None:
                break
            here, what, value = node
            if what >= 0:
                single = single or j == i
                arcs.append((i, j + 1, what, value))
                reached[j + 1] = True
        if not single:  # the character alone, by its bytes
            spelt = [bytes_of[b] for b in text[i].encode("utf-8", "surrogatepass")]
            arcs.append((i, i + 1, [b for b, _ in spelt], sum([v for _, v in spelt])))
            reached[i + 1] = True
    return arcs


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


class Expectation:
    """Expected uses of strings and bytes over all segmentations, summed over words."""

    def __init__(self, strings: dict[str, tuple[int, float]], bytes_of: list[tuple[int, float]], size: int) -> None:
        self.trie, self.bytes_of = trie_of(strings), bytes_of
        self.chances = trie_of({entry: (i, math.exp(value)) for entry, (i, value) in strings.items()})
        self.uses = [0.0] * size

    def add(self, word: str, n: float) -> None:
        """Adds n times the expected uses of the word."""
        text = SPACE + word
        if len(text) > PLAIN:
            self._add_long(text, n)
            return
        size, chances, uses = len(text), self.chances, self.uses
        forward, passes = [1.0] + [0.0] * size, [0.0] * size + [n]
        arcs = []
        add = arcs.append
        for i in range(size):
            here = forward[i]
            if here == 0.0:
                continue
            single, after = False, chances
            for j in range(i, size):
                node = after.get(text[j])
                if node is None:
                    break
                after, what, chance = node
                if what >= 0:
                    single = single or j == i
                    along = here * chance
                    forward[j + 1] += along
                    add((i, j + 1, what, along))
            if not single:  # the character alone, by its bytes
                spelt = [self.bytes_of[b] for b in text[i].encode("utf-8", "surrogatepass")]
                along = here * math.exp(sum([v for _, v in spelt]))
                forward[i + 1] += along
                add((i, i + 1, [b for b, _ in spelt], along))
        # Backward: of the uses that pass a position, each arc into it has its part of the forward sum.
        for i, j, what, along in reversed(arcs):
            share = passes[j] * along / forward[j]
            passes[i] += share
            if type(what) is int:
                uses[what] += share
            else:
                for b in what:
                    uses[b] += share

    def _add_long(self, text: str, n: float) -> None:
        """The same with logarithms, for words whose sums might be too small for a number."""
        size = len(text)
        arcs = arcs_of(text, self.trie, self.bytes_of)
        forward, passes = [0.0] + [-math.inf] * size, [0.0] * size + [n]
        for i, j, _, p in arcs:
            forward[j] = _log_add(forward[j], forward[i] + p)
        for i, j, what, p in reversed(arcs):
            share = passes[j] * math.exp(forward[i] + p - forward[j])
            passes[i] += share
            for b in [what] if type(what) is int else what:
                self.uses[b] += share


def _uses(model, size: int):  # noqa: ANN001, ANN202
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_uses = Expectation(*model.value, size)
        for batch in batches(parts):
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found_uses.add(word.decode("utf-8", "replace"), float(n))
        uses = np.array(found_uses.uses)
        found = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(uses[found])], names=["piece", "n"])

    return run


class Lattice:
    """Marginal probability of a word over all segmentations into vocabulary strings."""

    def __init__(self, scores: dict[str, float], byte_scores: list[float]) -> None:
        self.byte_scores = byte_scores
        self.trie = trie_of({entry: (0, value) for entry, value in scores.items()})

    def log_probability(self, word: str) -> float:
        """Natural logarithm; the forward recursion over character positions."""
        text = SPACE + word
        n = len(text)
        trie, exp, log = self.trie, math.exp, math.log
        incoming: list[list[float] | None] = [None] * (n + 1)
        here = 0.0
        for i in range(n):
            if i:
                arcs = incoming[i]
                incoming[i] = None
                if arcs is None:
                    continue
                if len(arcs) == 1:
                    here = arcs[0]
                else:
                    most = max(arcs)
                    here = most + log(sum([exp(x - most) for x in arcs]))
            single, after = False, trie
            for j in range(i, n):
                node = after.get(text[j])
                if node is None:
                    break
                after, what, score = node
                if what >= 0:
                    single = single or j == i
                    if (arcs := incoming[j + 1]) is None:
                        incoming[j + 1] = [here + score]
                    else:
                        arcs.append(here + score)
            if not single:  # the character alone, by its bytes
                spelt = here + sum(self.byte_scores[b] for b in text[i].encode("utf-8", "surrogatepass"))
                if incoming[i + 1] is None:
                    incoming[i + 1] = [spelt]
                else:
                    incoming[i + 1].append(spelt)
        arcs = incoming[n]
        most = max(arcs)
        return most + log(sum([exp(x - most) for x in arcs]))


class Vocabulary:
    """The existing vocabulary: its strings, single bytes and the order of their scores."""

    def __init__(self, path: str) -> None:
        processor = _processor(path)
        self.size = processor.get_piece_size()
        self.ids = [i for i in range(self.size) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
        own = np.array([processor.get_score(i) for i in self.ids])
        self.byte = np.array([processor.is_byte(i) for i in self.ids])
        self.pieces = [processor.id_to_piece(i) for i in self.ids]
        # Bytes and forbidden merges have no place of their own in the order; they come last.
        order = np.empty(len(self.ids))
        order[np.lexsort((np.arange(len(self.ids)), -own, self.byte))] = np.arange(len(self.ids))
        self.prior = 1.0 / (order + 3.0)

    def weights(self, uses: dict[int, float], ends: int) -> tuple[dict[str, tuple[int, float]], list[tuple[int, float]], float]:
        """Id and log probability of each string and of each byte, and the end's; all probabilities sum to 1."""
        n = np.array([uses.get(i, 0.0) for i in self.ids])
        mass = n + PRIOR * self.prior / self.prior.sum()
        whole = mass.sum() + ends + 1.0
        strings, bytes_of = {}, [(0, 0.0)] * 256
        for i, piece, value, is_byte in zip(self.ids, self.pieces, np.log(mass / whole).tolist(), self.byte.tolist(), strict=True):
            if is_byte:
                bytes_of[int(piece[3:5], 16)] = (i, value)
            else:
                strings[piece] = (i, value)
        return strings, bytes_of, math.log((ends + 1.0) / whole)


def fitted(spark: SparkSession, words: DataFrame, path: str, ends: int):  # noqa: ANN201
    """The weights after EM_ROUNDS rounds over the training words (word, n); at most a row for each string comes to the driver."""
    vocabulary = Vocabulary(path)
    weights = vocabulary.weights({}, 0)
    for _ in range(EM_ROUNDS):
        model = spark.sparkContext.broadcast(weights[:2])
        uses = words.filter("n > 0").mapInArrow(_uses(model, vocabulary.size), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        weights = vocabulary.weights({r["piece"]: r["n"] for r in uses.collect()}, ends)
    return weights


def _lattice_scores(model):  # noqa: ANN001, ANN202
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, bytes_of = model.value
        lattice = Lattice({k: v for k, (_, v) in strings.items()}, [v for _, v in bytes_of])
        for batch in batches(parts):
            # Bytes that are no UTF-8 never occur in a string column; replacing keeps the task alive if they do.
            scores = [lattice.log_probability(w.decode("utf-8", "replace")) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["word", "n", "lattice"])

    return run


_ROWS = "row_id long, doc_id long, word binary, tf long, n_tokens long, n_known long, base double, score double"


def _documents(frequent):  # noqa: ANN001, ANN202
    """For each document a row of what the frequent words give, and a row for each other word.

    The first kind of row has a word that no text can hold (it starts with a
    blank), different for each document, so that the join spreads them.
    """

    names = [x.split()[0] for x in _ROWS.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches(parts):
            row_ids, doc_ids = batch.column(0).to_numpy(), batch.column(1)
            rare: list[bytes] = []
            times: list[int] = []
            sums: list[tuple[int, int, int, float, float]] = []  # rare words, tokens, known, base, score
            for text in bytes_column(batch, "text"):
                words = Counter(tokens(text))
                own = [w for w in words if w not in known]
                rare += own
                times += map(words.__getitem__, own)
                often = [(words[w], *known[w]) for w in words if w in known]
                sums.append((len(own), words.total(), sum([n for n, _, _ in often]), sum([n * x for n, x, _ in often]), sum([n * x for n, _, x in often])))
            many, total, n_known, base, score = (np.array(x) for x in zip(*sums, strict=True))
            n = len(rare)
            none, zero = np.zeros(n, np.int64), np.zeros(n)
            ids = np.repeat(row_ids, many)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, pa.nulls(n, pa.int64()), pa.array(rare, pa.binary()), np.array(times, np.int64), none, none, zero, zero)], names=names)
            own_words = pa.array([b" %d" % k for k in row_ids], pa.binary())
            none = np.zeros(len(row_ids), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row_ids, doc_ids, own_words, none, total, n_known, base.astype(float), score.astype(float))], names=names)

    return run


def score_documents(spark: SparkSession, docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    scratch = Scratch(spark, "lm-scoring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = scratch.write(docs.mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    stats = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if(F.col("n") > 0).alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    total, ends = stats["total"], stats["ends"]
    whole = math.log10(total + 0.5 * (stats["distinct"] + 1))

    words = counted.filter("word is not null")
    strings, bytes_of, end_score = fitted(spark, words, vocabulary_path, ends)
    model = spark.sparkContext.broadcast((strings, bytes_of))
    table = scratch.write(words.mapInArrow(_lattice_scores(model), "word binary, n long, lattice double"), "words")
    scratch.drop("counts")

    # Each of these has more than total / FREQUENT tokens, so there are less than FREQUENT of them.
    often = table.filter(F.col("n") * FREQUENT > total)
    ten = math.log(10.0)
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): (math.log10(r["n"] + 0.5), r["lattice"] / ten) for r in often.collect()})

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").mapInArrow(_documents(frequent), _ROWS)
    rare = table.filter(F.col("n") * FREQUENT <= total).select(F.col("word").alias("rare"), "n", "lattice")
    joined = rows.join(rare, F.col("word") == F.col("rare"), "left")
    summed = joined.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"),
        (F.sum("n_tokens") + 1).alias("n_tokens"),
        (F.sum(F.col("n_known") + F.when(F.col("n") > 0, F.col("tf")).otherwise(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(F.col("tf") * F.log10(F.col("n") + 0.5), F.lit(0.0))).alias("base"),
        F.sum(F.col("score") + F.coalesce(F.col("tf") * F.col("lattice") / ten, F.lit(0.0))).alias("score"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return summed.select(
        "doc_id",
        (F.crc32(key.cast("binary")) % FOLDS == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(ends + 0.5)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("score") + F.lit(end_score / ten)).alias("score"),
    )

"""Packing, clustering and fill-in-the-middle against plain versions of their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fibrelark.llm import byte_pairs, clustering, fill_middle, packing
from fibrelark.llm import queries as llm_queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CLASHES = "n length size at row_id ids part upto width cluster v distance total form output h".split()
PIECES = ["a", "b", "s", "t", "re", "'", "'", " ", " ", "  ", "\n", "\t", "1", "22", "!", "é", "ſ", "İ", "×", "÷", "\xa0", "　", "中", "😀",
          "<|endoftext|>", "<|", "\x00", "\x1d", "\x85", "ª", "ve", "ll", "m", "d", "-", "\r\n", "\x7f", "don't", "Ā", "́", "²", "Ⅷ", "_", "long" * 9]


# Ids


def library_ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("stretch, remembered", [(1 << 22, 1 << 20), (64, 1 << 9)])
def test_ids_are_the_library_s(monkeypatch, stretch, remembered):
    monkeypatch.setattr(byte_pairs, "STRETCH", stretch)
    monkeypatch.setattr(byte_pairs, "REMEMBERED", remembered)
    rng = random.Random(stretch)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", "'s", "''s", " 's", "\n's", "a's'm'll", "'really", "x" * 500, " " * 400, "\n\n\n a", "中" * 300, "word " * 300]
    encoder = byte_pairs.Encoder(PATH)
    assert encoder.merges is not None
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == library_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [x.tolist() for x in ENCODER.encode([t.encode() for t in texts])] == library_ids(texts)


ENCODER = byte_pairs.Encoder(PATH)


def test_other_tokenizers_are_left_to_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = byte_pairs.Encoder(path)
    assert not own.known_pattern
    assert [x.tolist() for x in own.encode([b"It's a dog", b""])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(["It's a dog", ""], add_special_tokens=False)]


# Packing


def packed(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
    return packing.pack(spark, docs.repartition(5), PATH, **how).collect()


def check_pieces(rows, out, length):
    """Every id once, gapless sequences, at most one that is not full."""
    want = sorted((repr(d), [*ids, 1]) for (d, _, _), ids in zip(rows, library_ids([t or "" for _, _, t in rows]), strict=True))
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset and r.length > 0
        filled[r.sequence_id] = r.offset + r.length
        assert np.frombuffer(r.ids, "<u4").size == r.length
    assert sorted(filled) == list(range(len(filled))) and all(filled[k] == length for k in list(filled)[:-1])
    parts = {}
    for r in out:
        parts.setdefault((repr(r.doc_id), r.doc_tokens), []).append(r)
    total = sum(r.length for r in out)
    assert total == sum(len(ids) for _, ids in want)
    return want, parts, filled


def test_packing_keeps_every_id(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None]), " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 90])))) for k in range(300)]
    rows += [(900, "b", "long " * 3000), (901, "d", None), (902, "", "x")]
    length = 128
    out = packed(spark, rows, length=length)
    want, parts, _ = check_pieces(rows, out, length)
    for doc, ids in want:
        at = 0
        for r in sorted(parts[doc, len(ids)], key=lambda r: r.start):
            assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    # A packet is cut at a sequence's end only.
    assert all(r.start % length == 0 or r.offset == 0 for r in out)


def drift(out, length, share):
    """The furthest that a source's tokens in the first windows are from its target."""
    last = max(r.sequence_id for r in out)
    found = {s: np.zeros(last + 1) for s in share}
    for r in out:
        found[r.source][r.sequence_id] += r.length
    return max(np.abs(np.cumsum(found[s])[:-1] - np.arange(1, last + 1) * length * share[s]).max() for s in share)


def test_windows_keep_their_targets(spark):
    rng = random.Random(6)
    rows = [(k, "abcde"[min(4, int(rng.expovariate(1)))], "tok " * rng.randint(1, 120)) for k in range(1500)]
    out = packed(spark, rows, length=256)
    total = sum(r.length for r in out)
    share = {s: sum(r.length for r in out if r.source == s) / total for s in "abcde"}
    # A queue lags by a packet at most, and so does the stream by a packet of each.
    assert drift(out, 256, share) <= 256 * (1 + len(share))
    sizes = {n: drift([r for r in out if r.sequence_id < n], 256, share) for n in (50, 100, 200)}
    assert sizes[200] <= 256 * (1 + len(share))


def test_given_weights_hold_until_a_source_is_dry(spark):
    rows = [(k, "a", "tok " * 60) for k in range(400)] + [(1000 + k, None, "tok " * 60) for k in range(200)]
    weights = spark.createDataFrame([("a", 1.0), (None, 3.0)], "source string, weight double")
    out = packed(spark, rows, length=256, weights=weights)
    first = [r for r in out if r.sequence_id < 40]
    assert abs(sum(r.length for r in first if r.source is None) / sum(r.length for r in first) - 0.75) < 0.03
    check_pieces(rows, out, 256)
    with pytest.raises(Exception, match="positive weight"):
        packed(spark, rows, weights=weights.filter("source = 'a'"))


def test_packing_edges(spark):
    rows = [(None, None, "a b"), (None, None, "a b"), (3, "s", None), (3, "s", None), (4, "", "")]
    out = packed(spark, rows)
    check_pieces(rows, out, 2048)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in out) == [("3", 1), ("3", 1), ("4", 1), ("None", 3), ("None", 3)]
    assert packed(spark, []) == []


def test_sequences_are_filled_unless_a_power_of_two(spark):
    for words, size in ((5, 16), (7, 8)):
        pieces = packing.pack(spark, spark.createDataFrame([(1, "s", "a" + " a" * (words - 1) + " b" * 16)], "doc_id long, source string, text string"), PATH, length=16)
        rows = packing.sequences(pieces, 16, 9).orderBy("sequence_id").collect()
        ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
        assert [len(x) for x in ids] == [16, size] and rows[1].n_tokens == words + 1
        assert ids[1][words] == 1 and ids[1][words + 1 :] == [9] * (size - words - 1)


def test_packing_query(spark):
    out = llm_queries.op11_mixture_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ids = {d.doc_id: np.array([*i, 1], "<u4") for d, i in zip(docs, library_ids([d.text or "" for d in docs]), strict=True)}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in out)
    assert sum(r.length for r in out) == sum(map(len, ids.values()))


# Clustering


def plain_clusters(rows, k=8, rounds=10, seed=3, dim=64, scale=1024):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(scale * float(x))) for x in v]))
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    starts = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))[:k]
    centroids = [v for _, v in starts]

    def assign():
        far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
        return [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, of, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = assign()
    inertia = sum(d for d, _ in of)
    return sorted([(i, n, d, sum(e for e, m in of if m == n), inertia, tuple(centroids[n])) for (i, _), (d, n) in zip(kept, of, strict=True)], key=repr)


def clustered(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in clustering.cluster(spark, table, **how).collect()], key=repr)


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(size=dim) * spread + (k % 3)).astype("float32").tolist()) for k in range(n)]


@pytest.mark.parametrize("k, dim, spread", [(8, 64, 1.0), (8, 3, 0.002), (13, 2, 0.004)])
def test_clusters_match_a_plain_version(spark, k, dim, spread):
    rows = vectors(k, 120, dim, spread)  # narrow spreads give whole numbers with many ties
    assert clustered(spark, rows, k=k, dim=dim) == plain_clusters(rows, k=k, dim=dim)


def test_clustering_edges(spark):
    good = [0.5] * 63 + [-0.25]
    rows = [(1, good), (1, good), (1, [0.25] * 64), (None, good), (2, None), (3, []), (4, good[:63]), (5, [None] + good[1:]), (6, [float("nan")] + good[1:]), (7, [float("inf")] + good[1:])]
    out = clustered(spark, rows)
    assert out == plain_clusters(rows) and len(out) == 4
    assert clustered(spark, []) == [] and clustered(spark, rows[4:]) == []
    with pytest.raises(Exception, match="component beyond"):
        clustered(spark, [(1, [1e9] * 64)])
    with pytest.raises(ValueError, match="centroids"):
        clustered(spark, rows, k=1 << 20)


def test_annulus_compares_few_and_finds_ties():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-1000, 1000, (500, 2)) * rng.integers(1, 50, (500, 1))
    points = rng.integers(-40_000, 40_000, (2000, 2))
    search = clustering.Annulus(centroids)
    number, distance = search.nearest(points)
    apart = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert (distance == apart.min(1)).all() and (number == apart.argmin(1)).all()
    assert search.compared < points.shape[0] * len(centroids) / 3
    # Both centroids are as far, and stand at the two ends of the annulus.
    line = clustering.Annulus(np.array([[30, 0], [10, 0], [30, 0]]))
    assert [x.tolist() for x in line.nearest(np.array([[20, 0], [31, 0]]))] == [[0, 0], [100, 1]]


# Fill in the middle


def plain_middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12), st.text(alphabet="ab\n\r é中😀<PSM>", max_size=60), st.sampled_from([0, 60, 100]))
def test_rearranged_texts_match_a_plain_version(doc_id, text, rate):
    n, form, prefix, middle, output = fill_middle.rearrange(doc_id, text.encode(), 7, rate, 50)
    assert (n, form, prefix, middle, output.decode()) == plain_middle(doc_id, text, rate=rate)


@given(st.integers(0, 1 << 300), st.data())
def test_ranked_bits(bits, data):
    places = [k for k in range(bits.bit_length()) if bits >> k & 1]
    if places:
        rank = data.draw(st.integers(0, len(places) - 1))
        assert fill_middle.ranked_bit(bits, rank) == places[rank]
        assert fill_middle.ones_before(bits, places[rank]) == rank


def test_fill_in_the_middle_and_back(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "HANDED", 1000)
    rng = random.Random(4)
    texts = [None, "", "\n", "one line", "a<P>b", "x<S>", "<M>", "<", "ends in <P\nS>", "é\n中\n😀", "line\n" * 60_000]
    texts += ["".join(rng.choices(["ab", "\n", "<", "S>", "M", "é", " "], k=40)) for _ in range(150)]
    rows = [(None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (0, "a\nb"), (0, "a\nb"), *enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
    made = fill_middle.fill_in_middle(docs)
    out = made.select("*", fill_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    got = sorted([(r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out], key=repr)
    assert got == sorted([(d, t or "", *plain_middle(d, t)) for d, t in rows], key=repr)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0

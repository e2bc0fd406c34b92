"""The Jaccard join against all pairs on small tables."""

import random
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from fibrelark.llm import ngram_join
from fibrelark.llm.common import Scratch
from fibrelark.llm.components import Labels, components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_join(texts):
    """n_shingles and component of each text, by all pairs."""
    sets = []
    for text in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = WORDS.findall(lowered)
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    low = list(range(len(texts)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def varied(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", "  \n", "one two", "One TWO", "one two three four five", "É a é", "é a é"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([12, 30, 60, 200]))]
        for k in range(rng.randrange(1, 7)):
            texts.append(" ".join(varied(rng, base, k)))
    chain = [word() for _ in range(120)]
    for _ in range(10):  # each close to the one before only
        chain = varied(rng, chain, 2)
        texts.append(" ".join(chain))
    for _ in range(30):  # a passage that many share, with little else
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(1, 14))]))
    base = [word() for _ in range(80)]
    texts += [" ".join(varied(rng, base, rng.randrange(0, 4))) for _ in range(60)] + [" ".join(base)] * 30
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 16)  # so that chunks meet chunks in a small table
    texts = corpus(seed)
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], "doc_id long, text string, n long, class_id long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark, docs.repartition(5)).collect()}
    assert [got[k] for k in range(len(texts))] == plain_join(texts)
    kept = {r.doc_id for r in ngram_join.deduplicated(spark, docs).collect()}
    assert kept == {k for k, (_, c) in enumerate(plain_join(texts)) if k == c}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "z"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.near_duplicates(spark, docs).collect())
    assert out == [(-1, 1, -1), (-1, 2, 7), (3, 0, 3), (7, 2, 7), (7, 2, 7)]
    assert ngram_join.near_duplicates(spark, docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 60).selectExpr("id * 7 % 61 AS a", "(id * 7 + 7) % 61 AS b")
    out = {r.node: r.label for r in components(links, Scratch(spark, "chain")).collect()}
    assert out == dict.fromkeys(range(61), 0)


def test_labels_of_links_that_come_in_parts(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k * 7 % 61 + 1000, (k * 7 + 7) % 61 + 1000) for k in range(60)]
    labels = Labels(Scratch(spark, "labels"))
    labels.add(spark.createDataFrame(links[:0], "a long, b long"))
    assert labels.table.count() == 0
    for start in range(0, len(links), 107):
        labels.add(spark.createDataFrame(links[start : start + 107], "a long, b long"))
    got = {r.node: r.label for r in labels.table.collect()}
    low = {k: k for pair in links for k in pair}
    for _ in range(100):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    met = {k for a, b in links if a != b for k in (a, b)}
    assert got.keys() == met
    groups = lambda of: sorted(sorted(k for k in met if of[k] == x) for x in {of[k] for k in met})
    assert groups(got) == groups(low)


def test_one_row_of_each_component_stays(spark):
    same, near = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(58)) + " x y"
    rows = [(7, same, 0), (7, same, 1), (7, same, 2), (None, "a b c d e f", 3), (None, "a b c d e f", 4), (2, near, 5), (7, "the only one of its kind", 6)]
    rows += [(None, same, 7), (None, "", 8), (None, None, 9), (5, "p q r s t u", 10), (None, "p q r s t u", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id int")
    out = ngram_join.deduplicated(spark, docs.repartition(3))
    assert out.columns == docs.columns
    kept = sorted(r.row_id for r in out.collect())
    assert [k for k in kept if k not in (3, 4)] == [5, 6, 8, 9, 10] and len(kept) == 6
    assert ngram_join.deduplicated(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [None, 0])
def test_documents_are_not_shuffled_to_meet_few_surplus_rows(spark, most, monkeypatch):
    if most is not None:
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(corpus(3))] + [(0, None), (0, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ngram_join.deduplicated(spark, docs)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("SortMergeJoin" in plan) == (most == 0) and ("BroadcastHashJoin" in plan) == (most is None)
    texts = corpus(3)
    kept = [(k, texts[k]) for k, (_, low) in enumerate(plain_join(texts)) if low == k]
    assert got == sorted([*kept, (0, None), (0, None)], key=repr)


def test_finished_tables_leave_the_disk(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(corpus(3))], "doc_id long, text string")
    join = ngram_join.JaccardJoin(spark, docs, digests=True)
    assert join.surplus().count()
    assert [p.name for p in Path(join.scratch.path.removeprefix("file:")).iterdir()] == ["surplus"]


def test_tidy_has_executors_collect_their_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: sum(bean.getCollectionCount() for bean in beans if "Old" in bean.getName() or "MarkSweep" in bean.getName())
    asked = []
    context = SimpleNamespace(master="spark://far:7077", defaultParallelism=3, _jvm=spark.sparkContext._jvm)
    away = SimpleNamespace(sparkContext=context, range=lambda *a: asked.append(a) or spark.range(*a))
    scratch = Scratch(spark, "tidy")
    scratch.spark = away
    start = collected()
    scratch.tidy()
    assert asked == [(0, 3, 1, 3)] and collected() >= start + 2  # the driver's own, and the tasks'


def test_bitmaps_drop_inner_pairs_of_nodes(spark):
    """Of the pairs of inner nodes that sizes leave, over documents of one band of sizes as blocks hold them."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(6000).collect()]
    sets = {frozenset(s.tolist()): s for s in (ngram_join.shingle_set(t.encode()) for t in texts)}.values()
    for low, high in ((25, 60), (60, 150), (150, 400), (400, 900)):
        some = [s for s in sets if low <= len(s) < high][:512]
        bits = np.stack([np.frombuffer(ngram_join._bitmap(s).tobytes(), np.uint64) for s in some])
        n = np.array([len(s) for s in some])
        rows = {"n": n, "pos": np.zeros(len(n), np.int64), "label": np.arange(len(n))}
        counted = {}
        left, right = ngram_join._leaf_pairs(rows, bits, None, counted)
        assert len(some) > 60 and counted["bitmaps"] < 0.5 * counted["sizes"], (low, counted)
        found = {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist(), strict=True)}
        plain = [set(s.tolist()) for s in some]
        links = {(a, b) for a in range(len(some)) for b in range(a) if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])}
        assert {(b, a) for a, b in links} <= found

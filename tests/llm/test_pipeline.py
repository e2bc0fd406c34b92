"""The corpus pipeline against a plain version of its decisions."""

import random

import corpus_pipeline
import __spark_entry__
from fibrelark.llm import decontaminate, pii, quality_rules
from tests.llm.test_ngram_join import plain_join, varied


def test_pipeline_decisions(spark, tmp_path):
    rng = random.Random(8)
    common = ["the", "of", "and", "in", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else f"wo{rng.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    item = text(30)
    base = text(150)
    texts = [" ".join(text(rng.randrange(60, 160))) for _ in range(24)]
    texts += [" ".join(varied(rng, base, k)) for k in (0, 1, 2)] + [" ".join(base)]
    texts += [" ".join(text(40) + varied(rng, item, k) + text(40)) for k in (0, 3)]
    texts += [" ".join(text(60)) + " mail me.now@mail.example.com or 97.51.17.173 soon", "short one", "", None, "x " * 300, "$$$ ### " * 60]
    docs = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {r.doc_id for r in quality_rules.measure(spark.read.parquet(str(tmp_path / "documents.parquet"))).filter("kept").collect()}
    assert kept == set(range(31))
    low = plain_join([t if k in kept else "" for k, t in enumerate(texts)])
    kept = {k for k in kept if low[k][1] == k}
    items = decontaminate.Items([(0, " ".join(item))])
    kept -= {k for k in kept if decontaminate.search(items, texts[k])}
    assert kept == set(range(31)) - {25, 26, 27, 28, 29}

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    found = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        found = stage(spark, found, str(tmp_path))
        assert found.columns == columns
        path = str(tmp_path / f"stage{k}")
        found.write.parquet(path)
        found = spark.read.parquet(path)
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == kept
    assert all(r.text == pii.redact_text(texts[k]) and r.n_chars == len(r.text) for k, r in rows.items())
    assert "<EMAIL>" in rows[30].text and "<IP>" in rows[30].text
    mixed = corpus_pipeline.STAGES[-1][1](spark, found, str(tmp_path)).collect()
    sizes, taken = {}, {}
    for k, r in rows.items():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mixed:
        assert 1 <= r.copies <= 3 and r.text == rows[r.doc_id].text
        taken[r.source] = taken.get(r.source, 0) + r.copies * len(r.text.split())
    total = sum(sizes.values())
    for k, source in enumerate(sorted(sizes)):
        assert abs(taken[source] - min(total * (k + 1) / 6, 3 * sizes[source])) < 100


def test_registered_queries():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names

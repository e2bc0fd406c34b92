"""Nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names, for every operator."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from fibrelark.llm import chat_format, decontaminate, lm_scoring, mixing, pii, quality_rules, token_counts

TEXT = "the cat sat on the mat and the dog ran off to the hill where it saw a fox and a hen by the old red barn"
LONG = "so it goes on " * 12_000
ROWS = [(None, TEXT), (None, TEXT), (None, None), (7, TEXT), (7, TEXT), (7, "x y"), (8, ""), (9, " \t\n"), (10, LONG), (11, "word" * 50_000)]
CLASHES = "n_words n_chars kept size target copies row_id class_id h label spans score source lang item_id n bits __row __doc __m counts words".split()


@pytest.fixture(scope="module")
def docs(spark):
    columns = [f"'{c}' AS `{c}`" for c in CLASHES if c not in ("n_chars",)]
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", *columns, "cast(length(text) AS int) AS n_chars").cache()


def told(rows, *names):
    return sorted([tuple(r[n] for n in names) for r in rows], key=repr)


def test_lm_scores(docs):
    out = lm_scoring.score_documents(docs.sparkSession, docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(out) == len(ROWS)
    same = [r for r in out if r.n_tokens == len(TEXT.split()) + 1]
    assert len(same) == 4 and len({round(r.score, 9) for r in same}) == 1
    assert [r.n_tokens for r in out if r.doc_id == 10] == [48_001] and all(r.score < 0 for r in out)
    assert told([r for r in out if r.n_tokens == 1], "doc_id") == [(8,), (9,), (None,)]


def test_quality_rules(docs):
    out = quality_rules.measure(docs).collect()
    assert told(out, "doc_id", "n_words") == sorted([(d, len((t or "").split())) for d, t in ROWS], key=repr)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and told(kept.collect(), "doc_id") == [(7,), (7,), (None,), (None,)]
    assert quality_rules.filter_documents(docs.limit(0)).count() == 0
    assert quality_rules.measure(docs).filter("n_words > 20 and kept").count() == 4


def test_token_counts(docs):
    out = token_counts.count_tokens(docs.sparkSession, docs, public_tokenizers.path("word_bpe_49k.json"))
    rows = out.collect()
    assert told(rows, "doc_id", "n_bytes") == sorted([(d, len(t or "")) for d, t in ROWS], key=repr)
    assert {r.n_tokens for r in rows if r.n_bytes == len(TEXT)} == {len(TEXT.split())} and [r.over_limit for r in rows if r.doc_id == 10] == [True]
    assert token_counts.count_tokens(docs.sparkSession, docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_personal_data(docs):
    spark = docs.sparkSession
    rows = [(None, "mail a@b.co now"), (None, "mail a@b.co now"), (3, None), (4, "+1 " + "(555) 010-0199 " + "a " * 60_000 + "x@y.zz")]
    own = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES if c != "n_chars"])
    assert told(pii.scan(own).collect(), "doc_id", "n_email", "n_phone", "n_spans") == [(3, 0, 0, 0), (4, 1, 1, 2), (None, 1, 0, 1), (None, 1, 0, 1)]
    redacted = pii.redact(own)
    assert redacted.columns == own.columns
    assert [r.text for r in redacted.collect()][:3] == ["mail <EMAIL> now"] * 2 + [None]


def test_leaks(docs):
    spark = docs.sparkSession
    bench = spark.createDataFrame([(None, TEXT), (5, TEXT), (5, TEXT), (6, None)], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    found = decontaminate.find_leaks(spark, docs, bench)
    assert told(found.collect(), "doc_id", "item_id") == sorted([(d, i) for d in (None, None, 7, 7) for i in (None, 5, 5)], key=repr)
    kept = decontaminate.decontaminated(spark, docs, bench)
    assert kept.columns == docs.columns and told(kept.collect(), "doc_id") == sorted([(d,) for d, t in ROWS if t != TEXT], key=repr)


def test_mix(docs):
    out = mixing.mix(docs.sparkSession, docs)
    rows = out.collect()
    assert told(rows, "doc_id", "size") == sorted([(d, len((t or "").split())) for d, t in ROWS], key=repr)
    assert sum(r.taken for r in rows) == pytest.approx(rows[0].target, abs=1)


def test_conversations_without_an_id_are_one(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b" * 100_000), (None, 1, "assistant", None), (3, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS record_id", "1 AS n_turns")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(chat_format.turn_records(table))).collect()}
    assert out[None].n_turns == 3 and out[None].loss_chars == 100_000 and out[3].n_turns == 1
    assert out[3].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_pipeline_stages(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "mix_copies"]
    assert told(out.collect(), "doc_id", "text", "mix_copies") == [(7, TEXT, 1)]
    (tmp_path / "none").mkdir()
    for name, table in (("documents", docs.limit(0)), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        table.write.parquet(f"{folder}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0

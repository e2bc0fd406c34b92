"""Chat formatting, web archives and language-model scores against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fibrelark.llm import chat_format, lm_scoring, warc
from fibrelark.llm.common import Scratch


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\n\n<|>", max_size=6), st.text("a<\\|>\n im_endstar", max_size=30)), max_size=4))
def test_rendered_turns_read_back(turns):
    said = "".join(chat_format.render(role, text)[0] for role, text in turns)
    reader = chat_format.Reader()
    got = [turn for k in range(0, len(said), 7) for turn in reader.feed(said[k : k + 7])]
    assert got == turns and reader.left == ""


def test_layouts_meet_in_one_form():
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": "a"},
        {"response": "a", "prompt": "q"},
        {"question": "q", "answer": "a"},
    ):
        assert chat_format.canonical_turns(record) == want
    assert chat_format.canonical_turns({"role": "user", "text": None}) == [("user", "")]
    assert chat_format.canonical_turns({"messages": []}) == []
    assert chat_format.canonical_turns({"foo": 1}) is None


def test_chat_rows_match_a_plain_version(spark):
    rows = [(k % 7, k // 7, role, text) for k, (role, text) in enumerate([("user", "a<|im_end|>b"), ("assistant", "x" * 3000), (None, None), ("assistant", "é<\\|y\n"), ("system", "")] * 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(chat_format.turn_records(table))).collect()}
    for conv in range(7):
        turns = [(role or "", text or "") for c, _, role, text in sorted(rows, key=lambda r: r[1]) if c == conv]
        loss = "".join(text for role, text in turns if role == "assistant")
        r = out[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat_format.render(*t)[0]) for t in turns)
    written = Scratch(spark, "chat").write(chat_format.format_chat(chat_format.turn_records(table)), "segments")
    again = {r.conv_id: r for r in chat_format.read_back(chat_format.ordered_segments(written.repartition(3))).collect()}
    assert again == out
    assert chat_format.unknown_layouts(table.selectExpr("conv_id", "turn", "'{\"a\":[{\"b\":1}]}' AS record")).count() == len(rows)
    assert chat_format.read_back(chat_format.format_chat(chat_format.turn_records(table.limit(0)))).count() == 0


NESTED = "x" * 700 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + "y" * 900


def pages_of(spark):
    rows = [(k, f"http://a.example/{k}", "é<p>" + str(k % 9) * 1200 if k % 3 else "small") for k in range(150)]
    rows += [(1000 + k, None, NESTED) for k in range(6)] + [(1010, "http://x y\r\nz", None), (1011, "", ""), (None, "u", NESTED)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_archives_round_trip(spark, compression):
    rows, pages = pages_of(spark)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # plain archives are cut within records and payloads
    try:
        got = {r.page_id: r for r in warc.round_trip(spark, pages, compression).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(rows)
    last = {}
    for page_id, _, html in rows:
        if page_id is not None:
            last[html or ""] = max(page_id, last.get(html or "", -1))
    for page_id, _, html in rows:
        raw = (html or "").encode()
        r = got[page_id]
        response = last[html or ""] if page_id is not None and len(raw) >= 1000 else page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if response == page_id else ("revisit", response))


def test_pointers_jump_over_segments_of_a_file(spark, monkeypatch):
    """Version lines with false lengths inside payloads, a file of many segments: rounds are run and only true records come back."""
    false = "".join(f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n" for n in range(0, 4000, 7))
    rows = [(k, "u", f"{k} " + (false if k % 10 == 3 else "z" * 900)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    written = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *more: written.append(name) or write(self, df, name, *more))
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(spark, pages).collect()}
    assert got == {k: (len(h), hashlib.sha1(h.encode()).hexdigest()) for k, _, h in rows}
    assert "pointers-2" in written and "entries-3" in written


def test_a_damaged_chain_ends(spark):
    _, pages = pages_of(spark)
    path = Scratch(spark, "damage").at("archives")
    warc.write_archives(pages.filter("page_id < 20").coalesce(1), path, None)
    whole = warc.read_archives(spark, path)
    assert whole.count() == 20
    text = spark.read.text(path, wholetext=True).first()[0]
    cut = text.index("WARC/1.1", len(text) // 2)
    spark.createDataFrame([(text[:cut] + "junk" + text[cut:],)], "value string").coalesce(1).write.option("lineSep", "\n").text(path + "-cut")
    assert 0 < warc.read_archives(spark, path + "-cut").count() < 20
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_lattice_sums_over_all_segmentations():
    scores = {"▁": -1.0, "▁a": -1.5, "a": -2.0, "ab": -0.7, "b": -1.2, "abc": -3.0}
    lattice = lm_scoring.Lattice(scores, [-9.0] * 256)

    def total(text):
        if not text:
            return 1.0
        out = sum(math.exp(s) * total(text[len(p) :]) for p, s in scores.items() if text.startswith(p))
        return out + (0 if text[0] in scores else math.exp(-9.0 * len(text[0].encode())) * total(text[1:]))

    for word in ("a", "ab", "abab", "abcab", "é", "aéb", "bbbb", ""):
        assert lattice.log_probability(word) == pytest.approx(math.log(total("▁" + word)))
    assert math.isfinite(lattice.log_probability("ab" * 5000))


def test_lm_rows_match_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 20)  # so that most words come by the join
    texts = [None, "", "The cat", "the cat sat on the mat " * 5, "日本語 Éa é", "\x00 odd", *(f"word{k % 13} the W{k}" for k in range(60))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n long")
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in lm_scoring.score_documents(spark, docs.repartition(3), path).collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None] for k, t in enumerate(texts)}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in words}
    counts = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for k, ws in words.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert -1e6 < r.score < 0
    assert rows[0].score == rows[1].score > rows[2].score
    assert lm_scoring.score_documents(spark, docs.limit(0), path).count() == 0
    alone = lm_scoring.score_documents(spark, docs.filter("doc_id = 1 or doc_id = 3").filter(F.lit(False)), path)
    assert alone.collect() == []


def segmentations(text, strings, bytes_of):
    """Every way to spell the text, as (ids, log probability)."""
    if not text:
        yield [], 0.0
        return
    for k in range(1, len(text) + 1):
        if text[:k] in strings:
            i, p = strings[text[:k]]
            for ids, q in segmentations(text[k:], strings, bytes_of):
                yield [i, *ids], p + q
    if text[0] not in strings:
        spelt = [bytes_of[b] for b in text[0].encode()]
        for ids, q in segmentations(text[1:], strings, bytes_of):
            yield [*(i for i, _ in spelt), *ids], sum(p for _, p in spelt) + q


def test_scores_equal_sums_over_all_segmentations(spark):
    """The fitted weights and the score of whole documents, by enumeration."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the cat sat", "The cat saw the \u65e5 hat", "", "a ab abc abcd", "hat that", None, "xq zz", "the hats"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for k, t in enumerate(texts)}
    train = {k for k in words if zlib.crc32(str(k).encode()) % 5 != 1}
    assert 0 < len(train) < len(words)
    vocabulary = lm_scoring.Vocabulary(path)
    weights = vocabulary.weights({}, 0)
    for _ in range(lm_scoring.EM_ROUNDS):
        uses = Counter()
        for word, n in Counter(w for k in train for w in words[k]).items():
            ways = list(segmentations("\u2581" + word, *weights[:2]))
            total = sum(math.exp(p) for _, p in ways)
            for ids, p in ways:
                for i in ids:
                    uses[i] += n * math.exp(p) / total
        weights = vocabulary.weights(uses, len(train))
        mass = np.array([uses[i] for i in vocabulary.ids]) + lm_scoring.PRIOR * vocabulary.prior / vocabulary.prior.sum()
        assert weights[0]["\u2581the"][1] == pytest.approx(math.log(mass[vocabulary.pieces.index("\u2581the")] / (mass.sum() + len(train) + 1)))
    for r in lm_scoring.score_documents(spark, docs, path).collect():
        plain = weights[2] + sum(math.log(sum(math.exp(p) for _, p in segmentations("\u2581" + w, *weights[:2]))) for w in words[r.doc_id])
        assert r.score == pytest.approx(plain / math.log(10), rel=1e-9)


def test_expected_uses_of_long_words_equal_those_of_short_ones(monkeypatch):
    strings, bytes_of, _ = lm_scoring.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")).weights({}, 0)
    plain, logs = (lm_scoring.Expectation(strings, bytes_of, 32_000) for _ in range(2))
    for word in ("internationalisation", "\u65e5\u672c\U0001f600x", ""):
        plain.add(word, 3.0)
    monkeypatch.setattr(lm_scoring, "PLAIN", 0)
    for word in ("internationalisation", "\u65e5\u672c\U0001f600x", ""):
        logs.add(word, 3.0)
    assert logs.uses == pytest.approx(plain.uses)
    logs.add("ab" * 3000, 1.0)
    assert np.isfinite(logs.uses).all()


def test_weights_sum_to_one():
    strings, bytes_of, end = lm_scoring.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")).weights({300: 5000.0, 400: 70.0}, 12)
    assert sum(math.exp(p) for _, p in strings.values()) + sum(math.exp(p) for _, p in bytes_of) + math.exp(end) == pytest.approx(1.0)
    assert len(strings) > 31_000

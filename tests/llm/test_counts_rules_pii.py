"""Quality rules, token counts, personal data and mixing against plain versions of their contracts."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fibrelark.llm import mixing, pii, quality_rules, token_counts
from fibrelark.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [
    None, "", " \t\n\x0b\f\r ", "one", "a b c d e f g h i j k l m n o p q r s t u v",
    "x y z w v u t s " * 6, "Same line\nSame line\n\n \nSame line\r\n" * 3, "é́ ñ 日本語 　 x y" * 5,
    "#*$%&|<> " * 30, "word " * 5000, "a" * 30000, "the cat sat on the mat and the dog ran to it " * 3,
    "<|endoftext|> it's we'll <|startoftext|>x <|ENDOFTEXT|> don'T", "\x1c\x1d a\x85b   c",
]


def docs_of(spark, texts, sources=None):
    rows = [(k, t, (sources or [None] * len(texts))[k], 5, True) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, kept boolean")


def plain_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_match_a_plain_version(spark):
    out = quality_rules.measure(docs_of(spark, ODD_TEXTS)).collect()
    assert len(out) == len(ODD_TEXTS)
    for row in out:
        got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
        assert got == plain_rules(ODD_TEXTS[row.doc_id]), row.doc_id
        assert not (row.kept and row.base_failed)


def test_quality_rules_are_one_projection(spark):
    plan = quality_rules.measure(docs_of(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_quality_filter_keeps_all_columns(spark):
    docs = docs_of(spark, ODD_TEXTS)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    verdicts = {r.doc_id for r in quality_rules.measure(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdicts
    assert quality_rules.filter_documents(docs.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = token_counts.count_tokens(spark, docs_of(spark, ODD_TEXTS), path, limit=100).collect()
    assert len(out) == len(ODD_TEXTS)
    for row in out:
        text = ODD_TEXTS[row.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len(text.encode()), n > 100), text[:40]


def test_mixed_characters_count_as_in_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "REMEMBERED", 40_000)  # so that the worker forgets
    monkeypatch.setattr(token_counts, "SENT", 40)
    monkeypatch.setattr(token_counts, "STRETCH", 200)
    counter = token_counts.PieceCounter(path, token_counts.proven_whole(path))
    parts = ["a", "S", "'", "'s", "'LL", "\u00e9", "e\u0301", "\u0130", "\u0131", "\u00df", "\u1e9e", "\u017f", "\u00aa", "\u00b5", "\u00d7", "1", "\u0968", "\u00bd", " ", "\t", "\n"]
    parts += ["\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u200b", "\u03a3", "\u03c2", "<|", "<|endoftext|>", "<|EndOfText|>", "!", "-", "\x00", "\u4e2d", "\U0001f600", "\ufb01", "\u023a", "\u0181", "\u212a", "the", "Hello "]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["x" * 5000 + " " + "yz" * 300]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.count([]) == []


def test_proven_strings_are_single_tokens():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = token_counts.proven_whole(path)
    library = Tokenizer.from_file(path)
    assert len(whole) > 20_000
    assert all(len(library.encode(w.decode(), add_special_tokens=False).ids) == 1 for w in whole[::97])


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(d * 2, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    order = list(BASE)
    return sorted(out, key=lambda s: (s[1], order.index(s[0]), s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@+-() aZ_%é", max_size=60))
def test_base_spans_equal_a_leftmost_scan(text):
    base, more = pii.find_spans(text)
    assert base == plain_spans(text)
    assert not set(base) & set(more)


PII_TEXT = (
    "mail und.34@mail7.example.com, a@b a@b..c x@y.z@w.v ip 97.51.17.173 300.1.1.1 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 "
    "phone +1 (017) 555-7713 see https://example.org/a?b=c. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" "
    "IBAN DE89 3704 0044 0532 0130 00 é"
)


def test_pii_rows_and_redaction(spark):
    texts = [PII_TEXT, None, "", "no data here at all", PII_TEXT * 300]
    rows = {r.doc_id: r for r in pii.scan(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)
    base = plain_spans(PII_TEXT)
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    assert rows[0].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == tuple(sum(s[0] == k for s in base) for k in BASE)
    assert set(said.split(",")) <= set(rows[0].spans.split(","))
    for kind in ("url", "secret", "account"):
        assert f"{kind}:" in rows[0].spans
    assert rows[1].spans == rows[2].spans == rows[3].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs_of(spark, texts)).collect()}
    assert "example.com" not in clean[0] and "24be6443" not in clean[0] and "<EMAIL>" in clean[0]
    assert clean[3] == texts[3] and clean[1] is None and clean[2] == ""
    assert pii.scan(docs_of(spark, texts).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 400), st.integers(1, 30), min_size=1, max_size=12), st.floats(0, 1))
def test_fit_stays_within_the_counts_and_near_the_budget(counts, part):
    lengths = np.array(sorted(counts))
    there = np.array([counts[x] for x in sorted(counts)])
    budget = round(part * int((lengths * there).sum()))
    take = mixing.fit(lengths, there, budget)
    assert (take >= 0).all() and (take <= there).all()
    reach = {0}
    for length, n in zip(lengths, there, strict=True):
        reach |= {s + int(length) * k for s in reach for k in range(n + 1) if s + length * k <= budget + 400}
        if len(reach) > 40_000:
            return
    assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in reach)


def test_fit_beyond_the_programme(monkeypatch):
    monkeypatch.setattr(mixing, "FITTED", 500)
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 200, 30))
        counts = rng.integers(1, 500, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == budget
    one = mixing.fit(np.array([10**6]), np.array([7]), 3_400_000)
    assert one.tolist() == [3]


def test_targets_of_many_sources_equal_the_plain_version(spark):
    rng = np.random.default_rng(4)
    sizes = {f"s{k}\u00e9" if k % 5 else f"S{k}": int(10 ** rng.uniform(0, 6)) for k in range(60)} | {None: 500, "": 0}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    got = {r.source: (r.target, r.passes) for r in mixing.source_targets(Scratch(spark, "targets"), table).collect()}
    plain = mixing.targets(sizes)
    assert got.keys() == plain.keys()
    for source, target in plain.items():
        assert got[source][0] == pytest.approx(target, rel=1e-12)
        assert got[source][1] == (int(got[source][0] // sizes[source]) if sizes[source] else 0)
    assert mixing.source_targets(Scratch(spark, "targets"), table.limit(0)).count() == 0


def test_mix_of_rows_without_ids_and_clashing_columns(spark):
    rows = [(None, "a b c " * (k % 5), "x", 1, 2, 3) for k in range(40)] + [(7, "a b", "y", 1, 2, 3)] * 30 + [(8, None, None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int, copies int")
    out = mixing.mix(spark, docs)
    assert out.count() == 71
    sums = {r.source_size: (r.taken, r.target) for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
    assert all(abs(taken - target) <= 3 for taken, target in sums.values())
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == [*docs.columns, "mix_copies"]
    counted = collections.Counter()
    for r in mixed.collect():
        counted[r.source] += r.mix_copies * len((r.text or "").split())
    assert sorted(counted.values()) == sorted(taken for taken, _ in sums.values() if taken)


def test_targets_are_capped_and_reshared():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 50.0, "b": 100.0, "c": 150.0}
    capped = mixing.targets({"a": 1000, "b": 10, None: 10})
    assert capped["b"] == 30 and capped[None] == 30 and capped["a"] == pytest.approx(960)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(5)
    texts = ["w " * int(n) for n in rng.integers(0, 90, 600)] + ["copy of it"] * 300 + [None]
    sources = [str(x) for x in rng.choice(list("abé"), 600)] + ["hot"] * 300 + [None]
    docs = docs_of(spark, texts, sources)
    out = mixing.mix(spark, docs).collect()
    assert len(out) == len(texts)
    sums = collections.Counter()
    for r in out:
        assert r["size"] == len(WORDS.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 3 * r["size"]
        sums[sources[r.doc_id]] += r.taken
    for r in out:
        assert abs(sums[sources[r.doc_id]] - r.target) <= 3
    again = {r.doc_id: r.taken for r in mixing.mix(spark, docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    taken = {r.doc_id: r.copies for r in mixing.mixed_documents(spark, docs.cache()).collect()}
    assert taken == {r.doc_id: r.copies for r in out if r.copies}
    assert mixing.mix(spark, docs.limit(0)).count() == 0


def plain_url(text):
    """URLs by trying every place: a scheme in any case, then characters that are no blank, quote or bracket, closing marks left off."""
    out, end = [], 0
    for at in range(len(text)):
        scheme = next((s for s in ("http://", "https://", "ftp://") if text[at : at + len(s)].lower() == s), None)
        if scheme is None or at < end:
            continue
        stop = first = at + len(scheme)
        while stop < len(text) and not text[stop].isspace() and text[stop] not in "<>\"'|\\^`{}":
            stop += 1
        if stop == first or not (text[first].isascii() and text[first].isalnum()):
            continue
        full = stop
        while stop > first and text[stop - 1] in ".,;:!?)]}*$%&#":
            stop -= 1
        if stop > first:
            out.append(("url", at, stop))
            end = full
    return out


def test_added_kinds_match_plain_versions():
    rng = random.Random(12)
    parts = ["http://", "HttpS://", "FTP://", "a.b", "/x?y=1", " ", "(", ")", ".", ",", "\"", "é", "x", "\n", "www"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [s for s in pii.find_spans(text)[1] if s[0] == "url"] == plain_url(text), text
    for cue in ("ApiKey", "api_KEY", "Access_Key", "pAssword", "TOKEN", "Api-Key"):
        for between in (": ", "=", " := ", "=\"", " = '"):
            value = "".join(rng.choice("abcXYZ012_-/+.") for _ in range(rng.randrange(15, 60))) + "7a"
            text = f"İ say {cue}{between}{value} end"
            at = text.index(value)
            assert [s for s in pii.find_spans(text)[1] if s[0] == "secret"] == [("secret", at, at + len(value))], text
    for cue, value, found in (("Iban", "GB82 WEST 1234 5698 7654 32", True), ("IBAN:", "GB83 WEST 1234 5698 7654 32", False), ("account no.", "1234-5678", True), ("account", "1234567", False), ("myaccount", "12345678", False), ("Acct #", "1" * 18, True), ("acct", "1" * 19, True), ("acct", "1" * 34, True), ("acct", "1" * 35, False), ("account number is", "12345678", True), ("acct:    ", "12345678 90123456 789", True)):
        text = f"the {cue} {value}" + rng.choice([".", " AND SO ON", "-X", " é"])
        at = text.index(value)
        assert [s for s in pii.find_spans(text)[1] if s[0] == "account"] == ([("account", at, at + len(value))] if found else []), text


def test_secrets_behind_any_blanks_and_signs():
    for text, value in (
        ("password = 'abc123def456'", "abc123def456"), ("password:    abcdefgh12345678", "abcdefgh12345678"), ("token=>abcd1234", "abcd1234"),
        ("Authorization: Bearer abcDEF123456789xyz0", "abcDEF123456789xyz0"), ("secret : 1234567890123456", "1234567890123456"),
    ):
        assert pii.redact_text(text) == text.replace(value, "<SECRET>")
    for text in ("secret: 1234567890", "password: forgotten", "the bearer of 12 letters", "token 12345678abcd"):
        assert pii.redact_text(text) == text


def test_local_parsers_are_linear():
    for part in ("IBAN 1 ", "IBAN1", "token=a1", "account" + " " * 50, "password: ", "acct 12-", "bearer "):
        took = []
        for n in (4_000, 64_000):
            began = time.process_time()
            pii.find_spans(part * n)
            took.append(time.process_time() - began)
        assert took[1] < 80 * max(took[0], 0.02), part


def test_long_secrets_are_taken_whole():
    secret = "eyJ0" + "aB3_-x.Y9" * 120
    assert pii.redact_text(f"api_key = {secret} end") == "api_key = <SECRET> end"
    assert ("secret", 10, 10 + len(secret)) in pii.find_spans(f"api_key = {secret} end")[1]


@pytest.mark.parametrize("beside", ["{} 12/27", "99 {}", "7-{} 123", "{} 4000056655665556", "1 2 3 {} 4 5 6 7 8 9 10 11 12"])
def test_grouped_cards_beside_other_digits(beside):
    card = "4111 1111 1111 1111"
    text = "pay " + beside.format(card) + " now"
    base, more = pii.find_spans(text)
    at = text.index(card)
    assert base == plain_spans(text) and ("card", at, at + len(card)) in base + more
    assert "1111" not in pii.redact_text(text)

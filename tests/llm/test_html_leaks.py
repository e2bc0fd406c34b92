"""Main text on held-out pages, and leaks against a search of every place."""

import random
import time

import numpy as np
import pytest

from fibrelark.llm import decontaminate, html_extract
from fibrelark.llm.boosting import BoostedTrees

ARTICLE = (
    '<!DOCTYPE html><html><head><title>t &am</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">one</a></li>'
    '<li><a href="/b">two</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now.</div><article><h1>A title here</h1><p><b>First &amp; bold<br>'
    "<p>Second  par\n graph, with some words. And &copy more.</p><p>Be.</p></article><footer>&copy; host &middot; words here.</footer></body></html>"
)


@pytest.fixture(scope="module")
def model():
    return html_extract.fit_model([ARTICLE] * 5)


def extracted(model, html):
    page = html_extract.Page(html)
    return html_extract.kept_text(page, html_extract.decode(page, model.raw(html_extract.features(page))))


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    rows = rng.random((3000, 4))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 2] > 0.3)).astype(float)
    trees = BoostedTrees(n_trees=30, depth=3).fit(rows[:2000], labels[:2000])
    assert ((trees.raw(rows[2000:]) > 0) == labels[2000:]).mean() > 0.95


def test_article_comes_out_without_what_surrounds_it(model):
    assert extracted(model, ARTICLE) == "A title here First & bold Second par graph, with some words. And © more. Be."
    assert extracted(model, ARTICLE[: ARTICLE.index("</article>") - 8]).startswith("A title here First & bold Second")


def test_held_out_made_pages(model):
    maker = html_extract.Maker([f"w{k}" for k in range(500)], 77)
    right = kept = wanted = 0
    for _ in range(150):
        source = maker.page()
        page, marked = html_extract.Page(source), html_extract.MarkedPage(source)
        stays = html_extract.decode(page, model.raw(html_extract.features(page)))
        for node, text in page.blocks:
            right += len(text) * bool(stays[node] and marked.marked[node])
            kept += len(text) * bool(stays[node])
            wanted += len(text) * bool(marked.marked[node])
    assert right / kept > 0.95 and right / wanted > 0.95


def test_decoding_closes_upwards(model):
    rng = np.random.default_rng(2)
    page = html_extract.Page(ARTICLE)
    for _ in range(200):
        odds = rng.normal(size=len(page.tags))
        stays = html_extract.decode(page, odds)
        assert all(stays[page.parents[v]] for v in range(1, len(page.tags)) if stays[v])
        best = max(_closed_sums(page, odds))
        assert odds[stays].sum() == pytest.approx(max(best, 0.0))


def _closed_sums(page, odds):
    """Sums of all closed sets that hold the root, node by node from the top."""
    children = {}
    for v in range(1, len(page.tags)):
        children.setdefault(page.parents[v], []).append(v)

    def best(v):
        return odds[v] + sum(max(0.0, best(c)) for c in children.get(v, []))

    return [best(0)]


@pytest.mark.parametrize("html", ["", "plain", "<", "<p", "<p>a<", "<!-- no end", "</p></div>", "<div><table><td>a<td>b</table>", "<script>x", "a<br>b", "&#x110000;&amp", "<a href='x>y"])
def test_odd_markup_does_not_crash(model, html):
    assert isinstance(extracted(model, html), str)


def test_inline_elements_stay_in_their_sentence(model):
    html = ARTICLE.replace("Be.", 'A <span class="more">tag</span>ged word, <!-- a --><i class="ad">so</i> it is.')
    assert extracted(model, html).endswith("A tagged word, so it is.")


@pytest.mark.parametrize("html", ["<!-- a " * 4000, "<div>" * 4000 + "</span></p></x>" * 4000, "<p><button>" + "<div>" * 4000, "<ul>" + "<li><b class=ad>" * 4000, "<![CDATA[" * 4000, "<span class=ad>" * 4000 + "</i>" * 4000])
def test_hostile_pages_are_read_in_linear_time(html):
    def steps(source):
        began = time.process_time()
        html_extract.Page(source)
        return time.process_time() - began

    steps(html)
    assert steps(html * 4) < 12 * max(steps(html), 0.02)


def test_pages_come_back_whole(spark):
    rows = [(k, f"u{k}", ARTICLE.replace("Be.", f"Be {k}.")) for k in range(30)] + [(None, None, None), (5, "u5", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    out = html_extract.extract(spark, pages).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_chars == len(r.text)
    assert sum(r.text.endswith(f"Be {r.page_id}.") for r in out) == 30
    assert html_extract.extract(spark, pages.limit(0)).count() == 0


def plain_edits(item, words):
    """Least word edits between the item and any part of the words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        above, row = row, [i]
        for j, x in enumerate(words, 1):
            row.append(min(above[j - 1] + (w != x), above[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = f"z{rng.randrange(999)}"
        elif kind == 1:
            out.insert(at, f"z{rng.randrange(999)}")
        else:
            del out[at]
    return out


def test_leaks_match_a_search_of_every_place(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 12, 15, 30, 55, 90]))] for _ in range(25)]
    texts = []
    for k in range(260):
        own = items[k % 25]
        limit = decontaminate.edit_limit(len(own))
        before, after = ([rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))] for _ in range(2))
        said = before + edited(rng, own, rng.randint(0, limit + 3)) + after
        texts.append(" ".join(w.upper() + "!!" if k % 3 else w for w in said))
    texts += [None, "", "w1 w2", " ".join(items[0]) + " x " + " ".join(items[1]) * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS item_id")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, ""), (92, "w1 w2")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(spark, docs, bench).collect()}
    want = {}
    for d, text in enumerate(texts):
        words = decontaminate.words_of(text or "")
        for k, item in [*enumerate(items), (92, ["w1", "w2"])]:
            edits = plain_edits(item, words)
            if edits <= decontaminate.edit_limit(len(item)):
                want[d, k] = edits
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.97 * len(got)
    assert {k for k in want if k[1] == 92} <= set(got)  # no edits: the same buckets
    assert not any(r.item_id == 92 for r in decontaminate.find_leaks(spark, docs, bench, min_words=3).collect())
    kept = {r.doc_id for r in decontaminate.decontaminated(spark, docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.find_leaks(spark, docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(spark, docs, bench.limit(0)).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(40)]
    docs = spark.createDataFrame([(k, "start " + t + " end") for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted((r.doc_id, r.item_id, r.first_word, r.end_word) for r in decontaminate.find_leaks(spark, docs, bench).collect()) == [(k, k, 1, 21) for k in range(40)]


@pytest.mark.parametrize("n, times", [(8, 60), (30, 60), (48, 60), (49, 30), (120, 30), (250, 20), (500, 12), (1000, 4)])
def test_leaks_at_the_edit_limit_are_found_at_every_length(n, times):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(3000)]
    found = 0
    for _ in range(times):
        own = [rng.choice(vocabulary) for _ in range(n)]
        before, after = ([rng.choice(vocabulary) for _ in range(50)] for _ in range(2))
        said = before + edited(rng, own, decontaminate.edit_limit(n)) + after
        leaks = decontaminate.search(decontaminate.Items([(7, " ".join(own))]), " ".join(said))
        found += len(leaks) == 1
        assert all(leak[2] == plain_edits(own, said) for leak in leaks) or n <= decontaminate.SCREENED_WORDS
    assert found >= 0.99 * times


def test_exact_distance_equals_the_plain_table():
    rng = random.Random(6)
    for _ in range(3000):
        item = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        stretch = [rng.randint(0, 4) for _ in range(rng.randint(0, 20))]
        limit = rng.randint(0, len(item))
        found, least = decontaminate.edit_distance_within(item, stretch, limit), plain_edits(item, stretch)
        if least > limit:
            assert found is None
        else:
            edits, start, end = found
            assert edits == least == plain_edits(item, stretch[start:end])


def test_short_items_match_a_search_of_every_place():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in range(1, 8) for _ in range(6)]
    searched = decontaminate.Items([(k, " ".join(x)) for k, x in enumerate(items)])
    some = all_found = all_there = 0
    for _ in range(300):
        own = rng.choice(items)
        said = [rng.choice(vocabulary) for _ in range(rng.randrange(9))] + edited(rng, own, rng.randrange(min(3, len(own)))) + [rng.choice(vocabulary) for _ in range(rng.randrange(9))]
        got = {leak[0]: leak[2] for leak in decontaminate.search(searched, " ".join(said))}
        want = {k: plain_edits(x, said) for k, x in enumerate(items)}
        want = {k: edits for k, edits in want.items() if edits <= decontaminate.edit_limit(len(items[k]))}
        assert set(got) <= set(want) and all(got[k] <= decontaminate.edit_limit(len(items[k])) for k in got)
        assert all(k in got for k in want if len(items[k]) < decontaminate.PAIR_SEEDED)  # no edits: the same buckets
        all_found, all_there = all_found + len(got), all_there + len(want)
        some += bool(got)
    assert some > 50 and all_found >= 0.99 * all_there


def test_unspaced_scripts_are_cut_into_characters():
    assert decontaminate.words_of("Ab1 東京tower,カナ") == ["ab1", "東", "京", "tower", "カ", "ナ"]
    item = "東京は日本の首都であり世界最大の都市の一つです"
    changed = item.replace("首都", "中心")
    searched = decontaminate.Items([(1, item)])
    assert [leak[:3] for leak in decontaminate.search(searched, "これは前の文。" + changed + "。後の文")] == [(1, len(item), 2)]
    assert not decontaminate.search(searched, "これは前の文。後の文")


def test_each_row_is_decided_by_its_own_text(spark):
    item = " ".join(f"i{j}" for j in range(20))
    rows = [(None, item, 0), (None, "clean one", 1), (None, None, 2), (7, "clean two", 3), (7, "so " + item, 4), (7, "clean two", 5), (8, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminated(spark, docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.other for r in kept.collect()) == [1, 2, 3, 5, 6]

import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isohyet.llm import bloom_lm, decision_list, hd_langid, html_blocks, maxscore, queries

from ..compare import rows, tables

WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Quality rules


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


ODD = [None, "", "a", "a a a a", " a b a b a b a b\n", "a a a", "\n\na\n\na\n", "a b a b a", "x y z", "a b c d a b c", "a " * 5000, "\x0b\x0cé\xa0é #<|>", "😀 😀 😀 😀 😀 😀", " ".join(map(str, range(30000)))]


def test_statistics(spark):
    own = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)], "doc_id long, text string, n_words string")
    for r in decision_list.with_statistics(own).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(ODD[r.doc_id]), ODD[r.doc_id]


def test_quality_of_a_whole_table(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    got = queries.op2_decision_list(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule == 0)
    kept = {r.doc_id: r.kept for r in got if not r.base_failed}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [kept[d] for d, q in labels.items() if q == 1 and d in kept]
    bad = [kept[d] for d, q in labels.items() if q == 0 and d in kept]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def test_quality_uses_no_python(spark, sf_dir):
    out, _ = decision_list.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plan = decision_list.with_statistics(documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_rules_without_labels(spark):
    own = spark.createDataFrame([(1, "w " * 60 + "v"), (None, None), (1, "a b c " + " ".join(map(str, range(60))))], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    out, rules = decision_list.quality_rules(own, empty)
    assert rules == [] and sorted((r.n_words, r.kept) for r in out.collect()) == [(0, False), (61, False), (63, True)]
    assert decision_list.quality_rules(own.limit(0), empty)[0].count() == 0


def test_learning_finds_a_conjunction():
    rng = np.random.default_rng(0)
    data = []
    for _ in range(1500):
        row = {f: float(v) for f, v in zip(decision_list.FEATURES, rng.random(len(decision_list.FEATURES)))}
        data.append((row, row["symbol_ratio"] >= 0.7 and row["upper_ratio"] <= 0.4))
    rules = decision_list.learn_rules(data)
    said = [any(decision_list._holds(x, r) for r in rules) for x, _ in data]
    assert np.mean([a == y for a, (_, y) in zip(said, data)]) > 0.97
    assert decision_list.learn_rules([(data[0][0], False)] * 30) == []


# Language ID


def test_languages_of_held_out_documents(spark):
    own = documents(spark)
    got = {r.doc_id: r for r in queries.op6_hd_langid(spark, "/root/testdata/sf0.01").collect()}
    lang = {r.doc_id: r.lang for r in own.collect()}
    assert len(got) == len(lang)
    held = [d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (d in set(held)) and 0 <= got[d].score <= 1 for d in got)
    assert np.mean([got[d].lang_pred == lang[d] for d in held]) > 0.97


def test_language_edge_cases(spark):
    rows_ = [(1, "the house and the garden", "en"), (6, "the garden", "en"), (2, "das haus und der garten", "de"), (None, None, "en"), (3, "", "de"), (4, "123 !!", "en"), (5, "the " * 40000, None), (5, "der garten", None)]
    own = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in hd_langid.language_id(own, held_out=10**9).collect()]
    assert Counter(got) == Counter({(1, "en"): 1, (6, "en"): 1, (2, "de"): 1, (None, "und"): 1, (3, "und"): 1, (4, "und"): 1, (5, "en"): 1, (5, "de"): 1})
    assert {r.lang_pred for r in hd_langid.language_id(own.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert hd_langid.language_id(own.limit(0)).count() == 0
    assert {r.doc_id for r in hd_langid.known_language(own).collect()} == {1, 2, 5, 6}


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_grams(text):
    letters = hd_langid._alphabet()
    ids = [0, *(int(letters[ord(c)]) for c in text.lower() if not 0xD800 <= ord(c) < 0xE000), 0]
    ids = [x for i, x in enumerate(ids) if x or not i or ids[i - 1]]
    want = [a << 12 | b << 6 | c for a, b, c in zip(ids, ids[1:], ids[2:])]
    assert hd_langid.grams_of(text).tolist() == want


# Top-k search


def brute_top(embeddings, every=50, k=5):
    own = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in embeddings if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    first = {}
    for i, v in own:
        if i % every == 0:
            first[i] = min(v, first.get(i, v))
    out = []
    for q, v in first.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in own if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_search_like_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_maxscore(spark, sf)
    assert sorted(map(tuple, got.collect())) == brute_top(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    assert rows(got.toPandas()) == rows(tables(sf).sql(queries.ORACLE_SQL["op7_maxscore"]).df())


def test_search_edge_cases(spark):
    rng = np.random.default_rng(5)
    made = [(int(i), [float(x) for x in rng.normal(size=6).round(1)], 1) for i in range(300)]
    made += [(1000 + i, [0.5] * 6, 1) for i in range(40)] + [(400, None, 1), (401, [None] * 6, 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (450, [0.5] * 6, 1), (450, [0.1] * 6, 1), (500, [], 1), (501, [1.0, 2.0], 1)]
    own = spark.createDataFrame(made, "vec_id long, embedding array<float>, score int")
    want = brute_top(own.collect())
    assert sorted(map(tuple, maxscore.top_k(own).collect())) == want
    assert sorted(map(tuple, maxscore.top_k(own, chunk=3, rows=16).collect())) == want
    assert maxscore.top_k(own.limit(0)).count() == 0
    assert maxscore.top_k(own.filter("vec_id = 450")).count() == 0


# Language model


def test_base_scores_like_brute_force(spark):
    own = documents(spark).collect()
    words = {r.doc_id: [*r.text.encode().lower().split(), None] for r in own}
    count = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    total, distinct = sum(count.values()), len(count)
    for frequent in (1 << 19, 50):
        got = bloom_lm.lm_scores(documents(spark), frequent=frequent).collect()
        assert len(got) == len(own)
        for r in got:
            ws = words[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), total, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), rel=1e-9)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edge_cases(spark):
    own = spark.createDataFrame([(1, None, 0), (2, "a b c", 0), (2, "a b c", 0), (None, "", 0), (3, "zz " * 30000, 0)], "doc_id long, text string, score int")
    got = bloom_lm.lm_scores(own).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 4, 4, 30001] and all(r.score <= 0 and math.isfinite(r.base_score) for r in got)
    assert bloom_lm.lm_scores(own.limit(0)).count() == 0


def test_filter_keeps_counts():
    rng = np.random.default_rng(6)
    key = np.unique(rng.integers(0, 1 << 62, 20000).astype(np.uint64) * np.uint64(3))
    n = rng.geometric(0.3, len(key)) * rng.integers(1, 50, len(key))
    own = bloom_lm.Filter(dict(zip(*bloom_lm.build_segments(key, n, 16, 1 << 13))))
    level = own.levels(key)
    assert (level >= bloom_lm.quantised(n)).all() and (level == bloom_lm.quantised(n)).mean() > 0.9
    assert (own.levels(rng.integers(0, 1 << 62, 20000).astype(np.uint64)) > 0).mean() < 0.1
    exact = bloom_lm.quantised(n)
    assert (bloom_lm.low_edge(exact) <= n).all() and (bloom_lm.high_edge(exact) >= n).all()
    one = key % np.uint64(1 << 48)  # too many entries for one segment: the rarest are left out, the size holds
    segments, bits = bloom_lm.build_segments(one, n, 8, 1 << 12)
    assert segments.tolist() == [0] and len(bits[0]) == (1 << 12) // 8
    kept = bloom_lm.Filter({0: bits[0]}).levels(one)
    assert (kept[np.argsort(n)[-20:]] >= bloom_lm.quantised(np.sort(n)[-20:])).all()


def test_frequent_words_are_bounded(spark):
    words = spark.createDataFrame([(i, 1 + 1000 // (i + 1)) for i in range(500)], "key long, n long")
    for most in (0, 1, 10, 100, 499, 500):
        least = bloom_lm.least_frequent(words, most)
        assert words.filter(F.col("n") >= least).count() <= most
    assert bloom_lm.least_frequent(words, 500) <= 3


def test_model_is_a_distribution(spark):
    """Over all words of the vocabulary and the end, probabilities after a history sum to at most 1, up to wrong hits."""
    texts = [" ".join(np.random.default_rng(i).choice(list("abcdefgh"), 30)) for i in range(40)]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    filter_, words, keys, counts, total, distinct = bloom_lm.train(own, 16, 1 << 13, 100)
    after = np.array([bloom_lm._hash(c.encode()) for c in "abcdefgh"] + [bloom_lm.END], np.uint64)
    for h in after[:-1]:
        seen = bloom_lm.high_edge(filter_.levels(np.array([h], np.uint64)))[0]
        level = filter_.levels(after)
        pairs = bloom_lm.low_edge(filter_.levels(bloom_lm.pair_keys(np.full(len(after), h), after)))
        p = (pairs + 4 * (bloom_lm.low_edge(level) + 0.1) / (total + 0.1 * (distinct + 1))) / (seen + 4)
        assert 0.6 < p.sum() <= 1.001


# HTML


class Article(HTMLParser):
    """The blocks inside <article>, by another parser than the operator's."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.now = 0, [], []
        self.feed(page)

    def end_block(self, tag):
        if tag in ("article", "p", "h1", "h2", "h3", "h4", "div", "ul", "li", "blockquote", "pre"):
            text = " ".join("".join(self.now).split())
            self.done += [text] if text and self.depth else []
            self.now = []

    def handle_starttag(self, tag, attributes):
        self.end_block(tag)
        self.depth += tag == "article"
        self.now += [" "] if tag == "br" else []

    def handle_endtag(self, tag):
        self.end_block(tag)
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.now.append(data)


def article(page):
    return "\n\n".join(Article(page).done)


def test_main_text_of_a_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op1_block_lstm(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id for r in got} == set(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
    assert np.mean([r.text == article(pages[r.page_id].html) for r in got]) > 0.97


def test_blocks():
    of = lambda h: [b.text for b in html_blocks.leaf_blocks(h)]
    assert of("<p>a &lt;b&gt; &#233;&nbsp; c\n\td<p>e<br>f</p>g") == ["a <b> é c d", "e f", "g"]
    assert of("<div>x<script>var t='</p>';</script>y<style>p{}</style><!-- <p>no</p> --></div>") == ["xy"]
    assert of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert of("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert of('<p title="a>b">q</p><p') == ["q"] and of("a < b <c") == ["a < b"] and of("<" * 2000) == ["<" * 2000]
    assert of("<script>never closed <p>x") == [] and of("") == [] and of("</p></div>x") == ["x"]
    assert of("<p><b>one<br><p>two</p>") == ["one", "two"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "a", " ", "&amp", "&am;", "<!--", "-->", "<script>", "</script>", "<li", ">", "<a href=\"x>", "'", "\x00", "é"]), max_size=30))
def test_any_markup_is_read(parts):
    html_blocks.main_texts(["".join(parts)], html_blocks.model())


def test_html_edge_cases(spark):
    long = "<article><h1>Head of it.</h1>" + "".join(f"<p>Paragraph number {i}, with some words in it.</p>" for i in range(3000)) + "</article>"
    frame = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav>{long}<div class=comments><p>I think so.</p></div><footer>&copy; us</footer></body></html>"
    own = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<script>x</script>", "t"), (4, "u", frame, "t"), (4, "u", frame, "t"), (None, "u", "<nav><a>x</a></nav>", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_blocks.extract_main_text(own).collect()}
    assert got[1].text == got[2].text == got[3].text == "" and got[4].text == article(frame)
    assert html_blocks.extract_main_text(own).count() == 6 and html_blocks.extract_main_text(own.limit(0)).count() == 0


# Training


def test_training_learns():
    from isohyet.llm import html_training

    said = []
    html_training.train(hidden=8, pages=120, steps=100, batch=16, report=said.append)
    assert float(said[-1].split()[-1]) > 0.8

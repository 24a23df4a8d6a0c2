import numpy as np

from isohyet.llm import html_blocks


def plain_scores(blocks, w):
    """The labeller by loops over single numbers' rows, one block after the other."""
    x = html_blocks.features(blocks).astype(np.float64)
    w = {k: np.asarray(v, np.float64) for k, v in w.items()}
    n = len(w["v"]) // 2

    def direction(rows, i, u, b):
        h, c, out = np.zeros(n), np.zeros(n), []
        for row in rows:
            g = row @ i + h @ u + b
            s = 1 / (1 + np.exp(-g))
            c = s[n : 2 * n] * c + s[:n] * np.tanh(g[2 * n : 3 * n])
            h = s[3 * n :] * np.tanh(c)
            out.append(h)
        return out

    forward, backward = direction(x, w["wf"], w["uf"], w["bf"]), direction(x[::-1], w["wb"], w["ub"], w["bb"])[::-1]
    return np.array([f @ w["v"][:n] + b @ w["v"][n:] + w["c"] for f, b in zip(forward, backward)])


def page(n):
    return "<nav><a href=/>Home</a><a>More</a></nav><article><h1>Head.</h1>" + "".join(f"<p>Paragraph {i}, of some words.</p>" + ("<div class=ad>Buy it now</div>" if i % 9 == 4 else "") for i in range(n)) + "</article><footer>&copy; us</footer>"


def test_labeller_like_plain_loops():
    lstm = html_blocks.model()
    groups = [html_blocks.leaf_blocks(page(n)) for n in (1, 5, 40)]
    sizes = np.array([len(g) for g in groups])
    x = np.zeros((sizes.max(), 3, html_blocks.INPUTS), np.float32)
    for k, g in enumerate(groups):
        x[: sizes[k], k] = html_blocks.features(g)
    together = lstm.scores(x, sizes)
    for k, g in enumerate(groups):
        want = plain_scores(g, lstm.w)
        assert np.allclose(together[: sizes[k], k], want, atol=1e-3)
        for strip in (1, 7, 1000):
            assert np.allclose(lstm.long_scores(g, strip), want, atol=1e-3)


def test_strips_give_the_same_text():
    pages, lstm = [page(n) for n in (3, 50, 200)], html_blocks.model()
    assert html_blocks.main_texts(pages, lstm, strip=8) == html_blocks.main_texts(pages, lstm)


def test_many_blocks_and_levels():
    blocks = html_blocks.leaf_blocks("<p>x</p>" * 100_000)
    assert len(blocks) == 100_000 and len(html_blocks.model().long_scores(blocks)) == 100_000
    deep = "<div class=ad>" * 1000 + "<p>in</p>" + "</div>" * 1000 + "<p>out</p>"
    inside, outside = html_blocks.leaf_blocks(deep)
    assert inside.tags.max() == 4 and outside.tags.sum() == 2  # every level's end tag ends its own level


def test_whole_blocks_are_read():
    words = [f"w{i}" for i in range(200)]
    a, b = (html_blocks.features(html_blocks.leaf_blocks("<p>" + " ".join(own)))[0] for own in (words, [*words[:-1], "other"]))
    assert (a != b).any()
    a, b = (html_blocks.features(html_blocks.leaf_blocks("<p>" + "x" * 500 + end))[0] for end in "ab")
    assert (a != b).any()
    names = " ".join(f"n{chr(97 + i)}" for i in range(25))
    a, b = (html_blocks.features(html_blocks.leaf_blocks(f"<div class='{names} {last}'>x"))[0] for last in ("ad", "content"))
    assert (a != b).any()


def test_shown_instead_of_something_else():
    of = lambda h: [b.text for b in html_blocks.leaf_blocks(h)]
    assert of("<p>area <math><mi>x</mi></math> done <object>fallback</object></p>") == ["area x done fallback"]
    assert of("<noscript><p>please</p></noscript><svg><text>t</text><style>q{}</style></svg>") == ["please", "t"]
    assert of("<template><p>no</p></template>a<canvas>b</canvas>") == ["ab"]


def test_defined_cases(spark):
    rows = [(1, None, 5, 6), (None, "", 5, 6), (2, "<p>\ud83d\ude00 &#xD800; &unknown;</p>" * 3, 5, 6), (2, "<p>\ud83d\ude00 &#xD800; &unknown;</p>" * 3, 5, 6)]
    own = spark.createDataFrame(rows, "page_id long, html string, text int, n_chars int").withColumn("url", __import__("pyspark").sql.functions.lit(None).cast("string"))
    got = html_blocks.extract_main_text(own).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) and r.url is None for r in got)
    assert html_blocks.extract_main_text(own.limit(0)).columns == ["page_id", "url", "text", "n_chars"]

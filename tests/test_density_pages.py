"""Density clustering against planted groups, page reading on small pages, retries and fetch rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import html as H
from tidewire.functions import text as X
from tidewire.operators import density, providers
from tidewire.plans import catalog

D = "/root/testdata/sf0.001"


def blobs(k=3, n=50, dim=64, spread=0.1, noise=5):
    r = np.random.default_rng(42)
    mid = density.unit(r.normal(size=(k, dim)))
    x = np.concatenate([m + r.normal(0, spread / dim**0.5, (n, dim)) for m in mid] + [r.normal(size=(noise, dim))])
    return x, np.repeat(np.arange(k), n)


def test_planted_groups_are_found():
    x, truth = blobs()
    labels = density._labelled(x, density.Params())
    found = [set(labels[:150][truth == g]) - {-1} for g in range(3)]
    assert all(len(s) == 1 for s in found) and len(set.union(*found)) == 3
    assert (labels[:150] >= 0).mean() > 0.95
    y = density.reduce(density.unit(x), 10)
    assert density.validity(y, labels) > 0.5 > density.validity(y, np.random.default_rng(1).permutation(labels))


def test_tree_is_minimal():
    r = np.random.default_rng(7)
    x = r.normal(size=(40, 3))
    t = density._tree(x, np.zeros(40))
    edges = sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(40) for j in range(i))
    head, total = list(range(40)), 0.0
    for w, i, j in edges:
        a, b = head[i], head[j]
        if a != b:
            head, total = [a if h == b else h for h in head], total + w
    assert abs(t[:, 2].sum() - total) < 1e-9


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7])
def test_small_groups(n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    labels = density._labelled(x, density.Params())
    assert len(labels) == n and (n > 3 or (labels == 0).all())
    assert len(density._labelled(np.ones((n, 8)), density.Params())) == n


def test_safe_params():
    for n in range(1, 60):
        near, size, samples = density.safe(n, density.Params())
        assert 1 <= near <= max(1, n - 1) and size >= 2 and 1 <= samples < max(size, 2)
    with pytest.raises(ValueError):
        density.Params(components=1)


def test_cluster_and_grid(spark):
    x, _ = blobs(n=20)
    rows = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)] + [(5, 900, None)], "b bigint, id bigint, vec array<double>")
    out = density.cluster(rows, "b").toPandas()
    assert len(out) == len(x) and out.groupby("b")["cluster"].max().tolist() == [2, 2]
    best = density.grid_search(rows, "b", grid={"neighbors": (10,), "min_cluster": (3, 5), "min_samples": (1, 3), "epsilon": (0.0,)}).toPandas()
    assert len(best) == 2 and (best["score"] > 0.3).all()
    with pytest.raises(Exception, match="take finer groups"):
        density.cluster(rows, "b", most_rows=5).collect()


PAGE = """<html><head><title>A title</title><meta property="article:published_time" content="2024-01-02"><meta charset="x"></head><body><nav><a href="/x">menu menu menu menu menu</a></nav>
<div class="ad big">Buy</div><div><p>First   paragraph of &amp; text.<br>Second line.<p>Unclosed second.</div><script>var t = "</p>";</script><footer>foot</footer></body></html>"""


def test_read_page(spark):
    title, text, published, error = H.read_one(PAGE)
    assert (title, published, error) == ("A title", "2024-01-02", None)
    assert "First   paragraph of & text.\nSecond line." in text and "Unclosed second." in text
    assert not any(w in text for w in ("menu", "Buy", "foot", "var t"))
    assert H.read_one(None)[3] == H.read_one("")[3] == "NO_ARTICLE" and H.read_one("<p>words</p>")[3] == "NO_TITLE"
    assert H.read_one("<title>t</title><article><h1> </h1></article>")[3] in ("NO_TEXT", "NO_ARTICLE")
    r = spark.createDataFrame([(PAGE,), (None,)], "h string").select(H.article(F.col("h")).alias("a")).select("a.*").collect()
    assert r[0].text.startswith("First paragraph of & text.\nSecond line.") and r[1].error == "NO_ARTICLE"


def test_clean_page():
    out = H.clean_one(PAGE)
    assert "<script" not in out and "menu" not in out and "Buy" not in out and '<meta charset' not in out and "&amp;" in out
    assert H.clean_one('<div><p style="a" title="t">x</p><span> </span></div><b></b>') == '<div><p title="t">x</p></div><b></b>'
    assert H.clean_one(None) is None and H.clean_one("") == ""
    assert H.clean_one('<div><form>x<p>in it</div><p>Story two.</p>') == "<p>Story two.</p>"
    assert H.clean_one("<ul><li>a<nav>b</ul><p>c</p>") == "<ul><li>a</ul><p>c</p>"
    assert H.clean_one('<body class="has-modal"><div class="modal">x</div><p class="ad-free">y</p></body>') == "<body><p>y</p></body>"
    own = '<article><header><h1>T</h1></header><p>Text.</p><table><tr><td></td><td>5</td></tr></table><footer>By A.</footer></article>'
    assert H.clean_one(f'<header>site</header>{own}<footer>foot</footer>') == own
    gone = ['<div class="comments">c</div>', '<p class="x ads">a</p>', '<ul class="my-social-bar"><li>s</li></ul>', '<div id="social">s</div>', '<div class="share">s</div>', '<div class="related">r</div>', '<div class="recommended">r</div>',
            '<div class="newsletter">n</div>', '<div class="subscription">n</div>', '<div role="banner">b</div>', '<ol role="navigation"><li>x</li></ol>', '<b role="complementary">x</b>', '<section id="PayWall-1">x</section>', '<div class="modal-backdrop">x</div>', '<meta name="a" content="b">',
            '<div><span> &nbsp; <img src="x"></span></div>', "<p>", "<script>1</script>", "<form><p>x</p></form>"]
    for g in gone:
        assert H.clean_one(f"<p>a</p>{g}<p>b</p>") == "<p>a</p><p>b</p>", g
    assert H.clean_one('<body><div style="position: fixed">x</div><p>y</p></body>') == "<body><p>y</p></body>" and H.clean_one('<p class="shared headline">k</p><b> </b>') == "<p>k</p><b> </b>"
    assert "By A." in H.read_one(f"<title>t</title><footer>foot</footer>{own}")[1] and "foot" not in H.read_one(f"<title>t</title><footer>foot</footer>{own}")[1]
    whole = H.read_one('<title>t</title><body class="has-modal"><article><p>Some words of the story.</p></article></body>')
    assert whole[1] == "Some words of the story." and whole[3] is None


@pytest.mark.parametrize(("given", "want"), [
    ("https://A.b/c?utm_source=x&id=1&fbclid=2#f", "https://a.b/c?id=1#f"), ("HTTPS://A.B/c/../d", "https://a.b/d"), ("https://a.b:443/", "https://a.b/"), ("not a url", None), ("", None), (None, None),
    ("http://a.b:80/./x/%2E%2e/y/.", "http://a.b/y/"), ("http://a.b:8080", "http://a.b:8080/"), ("http://a.b:99999/", None), ("http://a.b:x/", None), ("https:///a.b/x", "https://a.b/x"), ("https://", None),
    ("  https://a.b/p q?x=1 2&utm_term=z ", "https://a.b/p%20q?x=1+2"), ("https://a.b/é?n=é", "https://a.b/%C3%A9?n=%C3%A9"), ("https://u:p@A.b/?gclid=1", "https://u:p@a.b/"), ("https://a.b\\c\\d", "https://a.b/c/d"),
    ("mailto:X@y.z", "mailto:X@y.z"), ("https://a b/", None), ("https://a.b/x?flag&a=%zz", "https://a.b/x?flag=&a=%25zz"), ("http://[::1]:80/x", "http://[::1]/x"), ("https://a.b/../../x", "https://a.b/x")])
def test_urls(spark, given, want):
    assert spark.range(1).select(X.clean_url(F.lit(given).cast("string")).alias("u")).head().u == want


def test_contents(spark):
    page = "<h3>lost</h3><h2>One</h2><u><strong>a <b>b</b></strong></u><h2>Two</h2><h3>c</h3>"
    one = lambda p: [(x.level, x.title, x.section) for x in spark.range(1).select(H.contents(F.lit(p)).alias("x")).head().x]
    assert one(page) == [(2, "One", "One"), (5, "a b", "One"), (2, "Two", "Two"), (3, "c", "Two")] and one("") == []


@pytest.mark.parametrize("name", ["page_articles", "clean_pages", "fetch_rounds", "density_clusters"])
def test_whole_tables(spark, name):
    table = "embeddings" if name == "density_clusters" else "pages"
    got = catalog.queries()[name](spark, D).collect()
    assert len(got) == spark.read.parquet(f"{D}/{table}.parquet").count()
    if name == "page_articles":
        assert all(r.error is None and r.title and "track(" not in r.text for r in got)


def test_rounds():
    assert providers.rounds(["a", "a", "b"], most=2) == [(0, 0), (0, 0), (1, 1000)]
    assert providers.rounds(["a", "a", "a"], most=2) == [(0, 0), (0, 0), (1, 5000)]
    assert providers.rounds([]) == []
    got = providers.rounds([f"h{i % 3}" for i in range(40)])
    for h in range(3):
        starts = sorted({s for i, (_, s) in enumerate(got) if i % 3 == h})
        assert all(b - a >= 5000 for a, b in zip(starts, starts[1:]))


def test_retry():
    class Busy(Exception):
        status = 503

    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return "ok"

    assert providers.retrying(call, wait=waits.append, draw=lambda: 1.0) == "ok" and waits == pytest.approx([0.5, 1.1])
    with pytest.raises(KeyError):
        providers.retrying(lambda: {}["x"], wait=waits.append)
    assert providers.delay(99, draw=lambda: 0.5) == 30.0


def test_items_and_embedding(spark):
    t = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id bigint, text string")
    assert [round(sum(v * v for v in r.embedding), 6) for r in providers.embed(t).orderBy("id").collect()] == [1.0, 0.0, 0.0]
    assert providers.item_format(["id", "embedding"]) == "embedding_item" and providers.item_format(["x"]) == "unknown"
    staged = providers.Staged().add("embed", providers.embed).add("items", providers.normalized_items)
    assert staged.run(t).count() == 3 and list(staged.took) == ["embed", "items"]


def test_trials_on_the_same_rows_share_their_work(monkeypatch):
    """Labels and scores are those of trials on their own; a hierarchy is merged once for each size and number of samples."""
    x = density.reduce(density.unit(np.random.default_rng(5).normal(size=(120, 8))), 3)
    trials = [(size, samples, eps) for size in (3, 5) for samples in (1, 3) for eps in (0.0, 0.2, 0.5)]
    alone = [density.density_labels(x, *t) for t in trials]
    scores = [density.validity(x, a) for a in alone]
    merges, merge = [], density.merge_group
    monkeypatch.setattr(density, "merge_group", lambda *a: merges.append(a) or merge(*a))
    trees, known = {}, {}
    for t, a, score in zip(trials, alone, scores, strict=True):
        labels = density.density_labels(x, *t, trees)
        assert (labels == a).all() and density.validity(x, labels, known) == score
    assert len(merges) == 4 and len(set(scores)) > 2

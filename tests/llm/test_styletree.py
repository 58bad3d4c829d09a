import math

from pyspark.sql import functions as F

from rollcall.llm import styletree as S

NAV = '<div class="nav"><a href="/home">Home</a><a href="/about">About us</a></div>'
FOOT = '<div class="foot"><p>All rights reserved by the site.</p></div>'


def page(i):
    return f'<html><head><title>t</title></head><body>{NAV}<div class="main"><h1>Title {i}</h1><p>Article number {i} says &amp; tells something of its own.</p></div>{FOOT}<script>x()</script></body></html>'


def test_shared_branches_go_and_articles_stay(spark):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", page(i)) for i in range(12)] + [(100, "http://single.org/", page(100))], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in S.extract(pages).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Title {i}\nArticle number {i} says & tells something of its own.", got[i]
        assert got[i]["n_removed"] >= 2
    assert "Home" in got[100]["text"] and got[100]["n_removed"] == 0


def test_importances_equal_the_formulas(spark):
    """Leaves: 1 less the mean entropy of features; here one feature is on all
    four pages and one on each page alone."""
    html = [f'<div id="a"><p class="s">Same.</p><p class="o">Own {i}.</p></div>' for i in range(4)]
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    tree = {round(r["importance"], 6) for r in S.style_tree(pages).collect()}
    assert 0.0 in tree and 1.0 in tree
    # Above the two text leaves: (0 + 1) / 2 at the div, damped once.
    g = S.GAMMA
    texts = {0.0, 1.0}
    p = {g * x for x in texts}
    div = g * sum(p) / 2
    assert {round(x, 6) for x in (texts | p | {div, g * div})} <= tree
    assert math.isclose(g, 0.9)


def test_parser_is_tolerant():
    for bad in ("", "<", "<div", "</p></div>", "<p>a<p>b", "<ul><li>1<li>2</ul>", "<!-- x", "<script>if (a < b) {}</script>t", '<a href="x>y', "<![CDATA[z", "a & b &lt;", "<br/><img src=x>", "\x00<p>\ud800"):
        S.text_of("h", bad, set())
    assert S.text_of("h", "<ul><li>1<li>2</ul>x", set())[0] == "1\n2\nx"
    assert S.text_of("h", "<script>if (a < b) {}</script>t", set())[0] == "t"


def test_letters_that_grow_in_lower_case_shift_nothing():
    assert S.text_of("h", "İİİİ<SCRIPT>x()</Script><p>hello world</p>", set())[0] == "İİİİ\nhello world"


def naive_tree(pages):
    """{place: (importance, most)} of one host by the definitions, recursively;
    a place is known by the styles and positions on the way to it."""
    places = {}

    def walk(node, place):
        kids = [k for k in node.kids if k.tag not in S._DROP]
        style = tuple((k.tag, k.look) for k in kids)
        found = places.setdefault(place, {"styles": [], "features": []})
        found["styles"].append(style)
        if not kids:
            found["features"].append(S.features(node))
        for i, k in enumerate(kids):
            walk(k, (place, style, i))

    for p in pages:
        walk(S.parse(p), ())

    def value(place):
        m = len(places[place]["styles"])
        if m == 1:
            return 1.0, 1.0
        own = {x: places[place]["styles"].count(x) for x in places[place]["styles"]}
        entropy = -sum(n / m * math.log(n / m) for n in own.values())
        shared = {x: n for x, n in own.items() if n > 1 and x}
        single = sum(1 for x, n in own.items() if n == 1 and x)
        if not shared:
            if len(own) == 1 and () in own:
                each = {}
                for fs in places[place]["features"]:
                    for f in set(fs):
                        each.setdefault(f, []).append(fs.count(f))
                mean = sum(-sum(c / sum(v) * math.log(c / sum(v)) for c in v) for v in each.values()) / len(each) if each else math.inf
                v = 1 - min(1.0, mean / math.log(m))
            else:
                v = 1.0
            return v, v
        below, top = single / m, 1.0 if single else 0.0
        for style, n in shared.items():
            kids = [value((place, style, i)) for i in range(len(style))]
            below += n / m * sum(k[0] for k in kids) / len(style)
            top = max([top, *(k[1] for k in kids)])
        damp = S.GAMMA ** len(own)
        v = (1 - damp) * min(1.0, entropy / math.log(m)) + damp * below
        return v, max(v, top)

    return sorted((round(v[0], 9), round(v[1], 9)) for p in places if len(places[p]["styles"]) > 1 for v in [value(p)])


def test_importances_equal_brute_force(spark):
    """Pages of one host that share some places and differ in others."""
    import random

    rng = random.Random(8)
    html = []
    for i in range(14):
        items = "".join(f"<li>{rng.choice(['one', 'two', f'own {i}'])}.</li>" for _ in range(rng.choice([2, 2, 3])))
        html.append(f'<body>{NAV}<ul class="{rng.choice("ab")}">{items}</ul><div><p>Text {i}. Shared sentence.</p>{rng.choice(["", "<img src=x>", "<b>bold</b>"])}</div>{FOOT}</body>')
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = sorted((round(r["importance"], 9), round(r["most"], 9)) for r in S.style_tree(pages).collect())
    want = naive_tree(html)
    assert len(got) == len(want) > 20
    assert all(math.isclose(a, b, abs_tol=1e-6) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_edges(spark):
    rows = [(1, "http://a/", None), (2, "http://a/", ""), (3, None, "<p>x</p>"), (4, None, "<p>x</p>"), (None, "http://b/", page(1)), (5, "HTTP://User@B:80/x", page(2)), (5, "HTTP://User@B:80/x", page(2)), (6, "http://long/", "<div>" * 20_000 + "deep" + "<p>y " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("host", F.lit("t")).withColumn("node", F.lit(1)).withColumn("_host", F.lit(1))
    out = S.extract(pages)
    by = {r["page_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and "html" not in out.columns
    assert by[1]["text"] == by[2]["text"] == "" and by[1]["n_removed"] == 0
    assert "deep" in by[6]["text"]
    assert S.extract(pages.limit(0)).count() == 0
    hosts = [r[0] for r in pages.select(S.host_of()).collect()]
    assert hosts == ["a", "a", "", "", "b", "b", "b", "long"]

"""Markup of the page format against results worked out by hand."""

from pyspark.sql import functions as F

from graphloom.operators import html

PAGE = """<body>
<section class="shortdescription"><p>gone</p></section>
<section><h2>One</h2>
<p>See <a href="./Some_Page?x=1">the <i>p</i>age</a>, <a href="./Empty"></a><a href="/wiki/Other">o</a>.<sup class="reference">[1]</sup></p>
<ul><li>x <a href="/wiki/A_b">ab</a><ul><li>deep</li></ul></li><li>y</li></ul>
<figure><a href="./File:A%20b.jpg">x</a><figcaption>Cap <a href="./C">c</a></figcaption></figure>
<figure><img src="z.png"></figure>
<table class="ambox"><tbody><tr><td>no</td></tr></tbody></table>
<table><tbody><tr><th>h</th><td><img src="//upload.wikimedia.org/c/thumb/a/ab/F%20g.svg/20px-F.png"> v</td></tr></tbody></table>
<p><img src="http://x.org/p.png"><img resource="./File:R.png"></p>
<h2>References</h2><p>gone</p></section></body>"""


def components(spark, *pages):
    rows = html.page_components(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id", "idx").collect()
    return [[r.asDict() for r in rows if r.page_id == i] for i in range(len(pages))]


def test_components_of_a_page(spark):
    base = "https://en.wikipedia.org/wiki/Special:FilePath/"
    found, = components(spark, PAGE)
    got = [(c["type"], c.get("paragraph") or c.get("table") or (c["src"], c["caption"]), c["edge"]) for c in found]
    assert got == [
        ("paragraph", "See the page , o .", ["Some_Page"]),
        ("paragraph", "- x ab - deep\n- y", ["A b"]),
        ("image", (base + "A b.jpg", "Cap c"), ["C"]),
        ("table", [["h", f"[[{base}F g.svg]] v"]], []),
        ("paragraph", f"[[http://x.org/p.png]] [[{base}R.png]]", []),
    ]
    assert {tuple(c["heading_path"]) for c in found} == {("One",)} and [c["idx"] for c in found] == list(range(5))


def test_heading_text_stays_as_it_is(spark):
    page = """<body><section><h2> H<sub>2</sub>O<sup class="reference">[1]</sup> <style>x{}</style></h2><p>a</p><h4>In <a href="./X">the</a>  deep</h4><p>b</p><h3>Up</h3><p>c</p></section>
      <section><h5>D</h5><p>d</p><h2>foot NOTES here</h2><p>gone</p><h2>Also gone</h2><p>gone</p></section><section><p>e</p><h2>New</h2><p>f</p></section></body>"""
    found, none, bad = components(spark, page, "<body><section><h2>Only</h2></section></body>", None)
    assert [(c["paragraph"], c["heading_path"]) for c in found] == [
        ("a", ["H2O[1]"]), ("b", ["H2O[1]", "In the  deep"]), ("c", ["H2O[1]", "Up"]),
        ("d", ["H2O[1]", "Up", "D"]), ("e", ["H2O[1]", "Up", "D"]), ("f", ["New"]),
    ]
    assert [c["error"] for c in [*none, *bad]] == ["no components"] * 2


def test_paths_by_a_fold_match_a_loop(spark):
    import random

    rnd = random.Random(8)
    pages = []
    for i in range(60):
        own, section = [], 0
        for _ in range(rnd.randint(0, 25)):
            section += rnd.random() < 0.2
            head = rnd.random() < 0.5
            own.append((section, rnd.randint(2, 6) if head else None, rnd.choice(["A", "B", "See also", "Sources of x", ""]) if head else None))
        pages.append((i, own))
    df = spark.createDataFrame(pages, "i int, e array<struct<section: int, level: int, title: string>>")
    got = {r.i: [(p["at"], p["heading_path"]) for p in r.p] for r in df.select("i", html.heading_paths(F.col("e")).alias("p")).collect()}
    for i, own in pages:
        path, want, closed = [], [], None
        for at, (section, level, title) in enumerate(own):
            if section == closed:
                continue
            if level is None:
                want.append((at, list(path)))
            elif any(c in title.lower() for c in html.CLOSING):
                closed = section
            else:
                path = [*path[: level - 2], title]
        assert got[i] == want


def test_a_task_holds_the_elements_of_few_pages(spark):
    import resource

    def most(batches):
        for pdf in batches:
            yield pdf.assign(m=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)

    workers = spark.range(16, numPartitions=16).mapInPandas(most, "id long, m double").agg(F.max("m"))
    page = "<body><section>" + "<p>a <a href='./B'>b</a> c</p>" * 100 + "</section></body>"
    before = workers.first()[0]
    pages = spark.range(10_000, numPartitions=1).select(F.col("id").alias("page_id"), F.lit(page).alias("html"))
    assert html.page_components(pages).groupBy("error").count().collect()[0]["count"] == 1_000_000
    after = workers.first()[0]
    assert after - before < 350, (before, after)  # MB

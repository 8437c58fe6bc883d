"""The stages that make a graph and answers: parts of components, labels, prompts, images, files, and both runs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import pipelines, schemas
from graphloom.config import Paths, Retrieval
from graphloom.functions import text as T
from graphloom.operators import asking, embedding, images, labelling, models
from graphloom.sources import readers, stored, web

COMPONENTS = "doc_title string, idx int, " + schemas.COMPONENT


def comp(title, idx, kind, **k):
    return (title, idx, kind, k.get("heading", ["H"]), k.get("edge", []), k.get("paragraph"), k.get("src"), k.get("caption"), k.get("table"))


def failing(size):
    class Failing(models.HashEmbedder):
        def embed(self, texts, images, boxes, instruction=None):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return super().embed(texts, images, boxes, instruction)

    return Failing(size)


def test_sentences(spark):
    text = 'Dr. Smith met J. Doe. They left! "Why?" he asked. Nobody knew.\nA line without end\n'
    got = spark.createDataFrame([(text,), ("",)], "t string").select(T.sentences(F.col("t")).alias("s")).collect()
    assert got[0].s == ["Dr. Smith met J. Doe.", "They left!", '"Why?" he asked.', "Nobody knew.", "A line without end"]
    assert got[1].s == [" "]


def test_parts_of_components(spark):
    rows = [
        comp("D", 0, "paragraph", paragraph="One.\nTwo.", heading=["A", "B"]),
        comp("D", 1, "table", table=[["h", "[[http://x/Pic.jpg]] p"], ["1", "2"], ["3", "[[http://x/Other.png]]"]]),
        comp("D", 2, "table", table=[["only", ""]]),
        comp("D", 3, "table", table=[]),
        comp("D", 4, "image", src="http://x/Pic.jpg", caption="cap"),
        comp("D", 5, "image", src="http://x/None.jpg", caption="cap"),
        comp("D", 6, "image", src="http://x/Other.png", caption=""),
        comp("D", 7, "video"),
        comp("D", 8, "paragraph", paragraph=None, heading=None),
    ]
    files = spark.createDataFrame([("Pic.png", "/f/Pic.png"), ("Other.png", "/f/Other.png"), ("Bare.png", "/f/Bare.png")], "image string, path string")
    meta = spark.createDataFrame([("Pic.png", "a pic", "", [[1, 2, 3, 4], [5, 6, 7, 8]]), ("Other.png", "", "read", [])], "image string, explanation string, ocr string, bboxes array<array<int>>")
    made = embedding.component_parts(spark.createDataFrame(rows, COMPONENTS), files, meta)
    got = {r.idx: [(p.text, p.image, p.box) for p in r.parts] for r in made.collect()}
    p = "D [SEP] H [SEP] "
    pic, other = " [SEP] <Image 1> Pic a pic", " [SEP] <Image {}> Other "
    assert got == {
        0: [("D [SEP] A , B [SEP] One.Two.", None, None), ("D [SEP] A , B [SEP] One.", None, None), ("D [SEP] A , B [SEP] Two.", None, None)],
        1: [
            ("h p [SEP] 1 2 [SEP] 3" + pic + other.format(2), "/f/Pic.png", None),
            (p + "h p [SEP] 1 2" + pic, "/f/Pic.png", None),
            (p + "h p [SEP] 3" + pic + other.format(2), "/f/Pic.png", None),
        ],
        2: [("only", None, None), (p + "only", None, None)],
        4: [(p + "cap [SEP] a pic", "/f/Pic.png", b) for b in (None, [1, 2, 3, 4], [5, 6, 7, 8])],
        6: [(p + " [SEP] read", "/f/Other.png", None)],
        8: [("D [SEP]  [SEP] ", None, None), ("D [SEP]  [SEP]  ", None, None)],
    }


def test_embedding_keeps_whole_documents(spark):
    rows = [comp("D", 0, "paragraph", paragraph="x"), comp("D", 1, "paragraph", paragraph="bad"), comp("E", 0, "paragraph", paragraph="A b. C d.")]
    none = spark.createDataFrame([], "image string, path string"), spark.createDataFrame([], "image string, explanation string, ocr string, bboxes array<array<int>>")
    made = embedding.embed_components(spark.createDataFrame(rows, COMPONENTS), *none, failing(8))
    good, failed = embedding.stored_documents(made)
    assert [(r.doc_title, r.error) for r in failed.collect()] == [("D", "ValueError: refused")]
    (row,) = good.collect()
    model = models.HashEmbedder(8)
    want = model.embed(["E [SEP] H [SEP] A b. C d.", "E [SEP] H [SEP] A b.", "E [SEP] H [SEP] C d."], [None] * 3, [None] * 3)
    assert np.allclose(row.embedding, want[0]) and np.allclose(row.vectors, want[1:])


def test_labels_within_documents(spark):
    rows = [
        comp("D", 0, "paragraph", paragraph="red fox runs"),
        comp("D", 1, "paragraph", paragraph="red fox (sleeps)"),
        comp("D", 2, "table", table=[["a", "b [[http://x/P.jpg]]"]]),
        comp("D", 3, "image", src="http://x/Q.jpg"),
        comp("E", 0, "paragraph", paragraph="the blue fox sleeps"),
        comp("Unlisted", 0, "paragraph", paragraph="x"),
    ]
    titles = spark.createDataFrame([("D", ["t1", "t2"], ["i1", "i2", "i3"], ["b1"]), ("E", ["t3"], [], ["b2"]), ("Gone", ["t4"], [], [])], "title string, text array<string>, image array<string>, table array<string>")
    refs = spark.createDataFrame([("t1", "text", "fox sleeps"), ("t2", "text", "nothing shared"), ("t3", "text", "fox runs"), ("b1", "table", "b"), ("b2", "table", "b")], "id string, kind string, value string")
    vectors = spark.createDataFrame([("P.png", [1.0, 0.0]), ("Q.png", [0.0, 1.0])], "image string, vector array<float>")
    asked = spark.createDataFrame([("i1", [1.0, 0.0]), ("i2", [1.0, 1.0])], "ref_id string, vector array<float>")
    out = labelling.label_documents(spark.createDataFrame(rows, COMPONENTS), titles, refs, vectors, asked)
    assert {(r.doc_title, r.idx): r.uuids for r in out.collect()} == {("D", 0): ["t2"], ("D", 1): ["t1"], ("D", 2): ["b1", "i1", "i2"], ("D", 3): [], ("E", 0): ["t3"]}
    assert labelling.labelled_ids(titles).first().n == 9 and labelling.labelled_ids(titles.limit(0)).first().n == 0


def test_asking(spark):
    rows = [
        (0, *comp("D", 0, "paragraph", paragraph="text")),
        (1, *comp("D", 1, "table", table=[["a,b", "[[http://x/No.jpg]]"], ["[[http://x/P.jpg]] c", "[[http://x/Q.jpg]]"]])),
        (2, *comp("D", 2, "image", src="http://x/Q.jpg", caption="cap")),
        (3, *comp("D", 3, "image", src="http://x/No.jpg", caption="cap")),
    ]
    comps = spark.createDataFrame(rows, "component_id long, " + COMPONENTS)
    files = spark.createDataFrame([("P.png", "/f/P.png"), ("Q.png", "/f/Q.png")], "image string, path string")
    results = spark.createDataFrame([("q", i + 1, i) for i in range(4)] + [("r", 1, 0)], "qid string, rank int, component_id long")
    questions = spark.createDataFrame([("q", "what?"), ("r", "fail")], "qid string, question string")

    class Picky:
        def generate(self, prompts, images, max_tokens=256):
            if any("fail" in p for p in prompts):
                raise RuntimeError("no")
            return [f"{len(i)} images" for i in images]

    got = {r.qid: r for r in asking.ask(questions, results, comps, files, Picky()).collect()}
    assert got["q"].images == ["/f/P.png", "/f/Q.png"] and got["q"].answer == "2 images" and got["q"].error is None
    head = "Title: D\nSection: H\n\n"
    assert "[Table]\n" + head + "a , b | \n<Image 0> , c | \n*/\n" in got["q"].prompt
    assert "[Image]\n" + head + "<Image 1>\nCaption: cap\n*/\n" in got["q"].prompt and "[Image]\n" + head + "*/\n" in got["q"].prompt
    assert (got["r"].answer, got["r"].error, got["r"].images) == ("[Generation Failed]", "RuntimeError: no", [])
    with pytest.raises(Exception, match="no truth for qid r"):
        asking.ask(questions, results.where("qid = 'q'"), comps, files, Picky()).collect()


def test_images_and_files(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (6, 10, 3), np.uint8)
    files = spark.createDataFrame([("a b!.png", images.png(pixels)), ("broken.png", b"nothing")], "name string, content binary")
    folder = f"file://{tmp_path}/in"
    assert [r.error for r in stored.save_files(files, folder).collect()] == [None, None]
    rows = {r.path.rpartition("/")[2]: r for r in images.decoded(spark, folder).collect()}
    assert rows["broken.png"].data is None and rows["broken.png"].error == "not an image"
    shown = np.frombuffer(rows["a%20b!.png" if "a%20b!.png" in rows else "a b!.png"].data, np.uint8).reshape(6, 10, 3)[:, :, ::-1]
    assert (shown == pixels).all()
    made = {r.image: r for r in images.normalised(images.decoded(spark, folder), pixels=15).collect()}
    small = made.pop(next(k for k in made if k != "broken.png"))
    stored.save_files(spark.createDataFrame([("s.png", small.content)], "name string, content binary"), f"file://{tmp_path}/out").collect()
    again = images.decoded(spark, f"file://{tmp_path}/out").first()
    assert (again.width, again.height, again.channels) == (5, 3, 3) and made["broken.png"].error == "not an image"
    flat = np.full((8, 8, 3), 77, np.uint8)
    assert (images.resized(flat, 3, 5) == 77).all() and images.resized(flat, 3, 5).shape == (5, 3, 3)


def test_cached_questions(spark):
    class Plans(models.RuleGenerator):
        def generate(self, prompts, images, max_tokens=256):
            if any("broken" in p for p in prompts):
                raise RuntimeError("no")
            return super().generate(prompts, images, max_tokens)

    questions = spark.createDataFrame([("a", "one and two"), ("b", "broken"), ("c", "")], "qid string, question string")
    got = {r.qid: r for r in models.cache_questions(questions, Plans(), models.HashEmbedder(8)).collect()}
    want = models.HashEmbedder(8).embed(["one", "two"], [None] * 2, [None] * 2, "text")
    assert got["a"].subqueries == ["one", "two"] and np.allclose(got["a"].vectors, want) and got["a"].error is None
    assert got["b"].vectors is None and got["b"].embedding is None and got["b"].error == "RuntimeError: no"
    assert got["c"].vectors == [] and got["c"].embedding is not None


def test_stored_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stored.load_graph(spark, str(tmp_path / "none"))
    row = spark.createDataFrame([comp("D", 0, "image", src="s", caption="é", paragraph="not this")], COMPONENTS)
    got = json.loads(row.select(stored.tagged_json()).first()[0])
    assert got == {"type": "image", "heading_path": ["H"], "edge": [], "src": "s", "caption": "é"}
    assert row.withColumn("type", F.lit("video")).select(stored.tagged_json()).first()[0] is None
    assert spark.range(1).select(T.rate(F.lit(0.5)), T.percent(F.lit(12.5))).first()[:] == ("0.5000", "12.50%")


PAGE = """<html><body><section><p>{title} is a <a href="./Fox" rel="mw:WikiLink" title="Fox">fox</a>. It runs far.</p>
<figure><a href="./File:{title}.png"><img src="x.png"/></a><figcaption>a {title}</figcaption></figure></section></body></html>"""


def test_both_runs(spark, tmp_path):
    picture, page = images.png(np.zeros((4, 4, 3), np.uint8)), PAGE

    class Web:
        def fetch(self, url):
            if "/page/html/" in url and not url.endswith("Gone"):
                return page.format(title=url.rpartition("/")[2]).encode()
            if "commons" in url:
                return picture
            raise OSError("404")

    class Boxes:
        def detect(self, images):
            return [[(0.1 * i, [0, 0, i, i]) for i in range(5)] for _ in images]

    base = pipelines.TITLE_PREFIX
    dev = [("q1", "which fox and what runs?", [("far?",)], [("t1", "text"), ("i1", "image")]), ("q2", "who is gone?", [("x",)], [("t2", "text"), ("t3", "text")])]
    bench = {
        "dev": spark.createDataFrame(dev, schemas.QA_DEV),
        "texts": spark.createDataFrame([("t1", "Fox is a fox", base + "Fox"), ("t2", "Dog it runs far", base + "Dog"), ("t3", "x", base + "Gone")], schemas.QA_TEXTS),
        "images": spark.createDataFrame([("i1", base + "Fox", "i1.png")], schemas.QA_IMAGES),
        "tables": spark.createDataFrame([], schemas.QA_TABLES),
    }
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "i1.png").write_bytes(picture)
    tools = pipelines.Models(Web(), Boxes(), models.RuleGenerator(), models.HashEmbedder(16), images.HashImageEmbedder())
    paths = Paths(f"file://{tmp_path}/run")
    at = paths.table
    for _ in range(2):  # the second run finds all done but what failed
        timer = pipelines.preprocess(spark, paths, bench, tools, web.Pace(tries=1), f"file://{tmp_path}/refs")
    assert timer.total == sum(s for _, s in timer.seconds) and [n for n, _ in timer.seconds][:2] == ["pages", "parse"]
    assert sorted(r.title for r in spark.read.parquet(at("html")).collect()) == ["Dog", "Fox"]
    assert [r.title for r in spark.read.parquet(at("html_failed")).collect()] == ["Gone"]
    pages = readers.jsonl(spark, at("pages"), schemas.PAGE)
    assert pages.count() == 2 and spark.read.parquet(at("image_vectors")).count() == 2
    assert all(r.bboxes == [[0, 0, 4, 4], [0, 0, 3, 3], [0, 0, 2, 2]] for r in readers.jsonl(spark, at("detections"), schemas.DETECTION).collect())
    g = pipelines.build_graph(spark, paths, bench, tools)
    comps = {(r.doc_title, r.idx): r for r in g.components.collect()}
    assert [comps[k].component_id for k in sorted(comps)] == [0, 1, 2, 3]
    assert {k: r.uuids for k, r in comps.items()} == {("Dog", 0): ["t2"], ("Dog", 1): [], ("Fox", 0): ["t1"], ("Fox", 1): ["i1"]}
    assert {r.component_id: len(r.vectors) for r in g.subs.collect()} == {0: 2, 1: 3, 2: 2, 3: 3}
    assert {tuple(r) for r in g.edges.collect()} >= {(0, 2), (0, 3)}
    out = pipelines.answer(spark, paths, bench, tools, Retrieval(beam_size=4, top_k=4))
    assert {r.qid for r in out["answers"].collect()} == {"q1", "q2"} and out["match"].first().n == 2
    assert out["match"].first().exists_n == 2 and out["match"].first().perfect_n == 1
    assert out["scores"].first().n == 2 and spark.read.json(at("answers")).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        pipelines.build_graph(spark, paths, bench, tools)

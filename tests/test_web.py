"""Fetching from a local server: odd names, fallbacks, retries, pace and errors as rows."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from graphloom import pipelines
from graphloom.functions import text as T
from graphloom.sources import web

TITLES = ["Été", "A b", "C_(d)", "Who?", "50%_off", "a+b", "x/y", "中文", "plain", "#1", "it's_\"q\""]


@pytest.fixture(scope="module")
def server():
    seen, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            path = unquote(self.path)
            with lock:
                seen.append((time.monotonic(), self.path))
                before = Counter(p for _, p in seen)[self.path]
            code = 404 if "gone" in path else 503 if "busy" in path or "flaky" in path and before < 3 else 200
            body = f"<p>{path}</p>".encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", seen
    made.shutdown()


def test_odd_names_and_errors(spark, server):
    base, seen = server
    titles = spark.createDataFrame([(t,) for t in [*TITLES, "gone", "busy"]], "t string")
    urls = titles.select(F.concat(F.lit(f"{base}/page/"), T.url_part(F.col("t"))).alias("url"))
    more = spark.createDataFrame([(f"{base}/raw/A b é.jpg",), (f"{base}/flaky",), (f"{base}/flaky",), (None,), ("",), ("nowhere",)], "url string")
    got = web.fetched(urls.unionByName(more), web.HttpFetcher(), pace=web.Pace(backoff=0.01)).collect()
    good = Counter(bytes(r.content).decode() for r in got if r.error is None)
    assert good == Counter([*(f"<p>/page/{t}</p>" for t in TITLES), "<p>/raw/A b é.jpg</p>", "<p>/flaky</p>", "<p>/flaky</p>"])
    bad = {(r.url or "").rpartition("/")[2]: (r.error.partition(":")[0], r.calls) for r in got if r.error}
    assert bad == {"gone": ("HTTPError", 1), "busy": ("HTTPError", 3), "": ("no url", 0), "nowhere": ("ValueError", 1)}
    assert sum(r.error == "no url" for r in got) == 2 and max(r.calls for r in got if "flaky" in (r.url or "")) <= 3
    assert web.fetched(urls.where("false"), web.HttpFetcher()).collect() == []


def test_forms_follow_each_other(spark, server):
    base, _ = server
    urls = spark.createDataFrame([(f"{base}/gone/A b.png",), (f"{base}/gone/gone.png",)], "url string")
    got = {r.url.rpartition("/")[2]: r for r in web.fetched(urls, web.HttpFetcher(), ("{url}", base + "/else/{file}")).collect()}
    assert bytes(got["A b.png"].content) == b"<p>/else/A b.png</p>" and got["A b.png"].calls == 2
    assert got["gone.png"].content is None and got["gone.png"].error.startswith("HTTPError")


def test_a_host_is_asked_at_its_rate(spark, server):
    base, seen = server
    seen.clear()
    urls = spark.range(24).select(F.concat(F.lit(f"{base}/slow/"), "id").alias("url"))
    assert web.fetched(urls, web.HttpFetcher(), pace=web.Pace(rate=20, lanes=3)).count() == 24
    times = sorted(t for t, p in seen if "/slow/" in p)
    for a in times:  # three lanes may begin together
        assert sum(a <= t < a + 0.45 for t in times) <= 9 + 3


def test_pages_and_images_of_a_crawl(spark, server, monkeypatch):
    base, _ = server
    monkeypatch.setattr(pipelines, "PAGE_URL", f"{base}/page/")
    monkeypatch.setattr(pipelines, "IMAGE_URLS", ("{url}", f"{base}/FilePath/{{file}}"))
    titles, done = spark.createDataFrame([(t,) for t in [*TITLES, "gone"]], "title string"), spark.createDataFrame([("plain",)], "title string")
    got = {r.title: r for r in pipelines.crawl_pages(titles, done, web.HttpFetcher(), web.Pace(tries=1)).collect()}
    assert {t: r.html for t, r in got.items() if not r.error} == {t: f"<p>/page/{t}</p>" for t in TITLES if t != "plain"} and got["gone"].error
    page = "title string, comp_data array<struct<src:string,caption:string,paragraph:string,table:array<array<string>>>>"
    comps = [(f"{base}/gone/F g.svg", "a [[B c.JPG]]", None, None), (None, None, "x [[//h.org/e.png]] [[no file]]", [["[[File:R é.png]] t", None], None]), (f"{base}/ok/F g.svg", None, "F.png", None)]
    pages = spark.createDataFrame([("D", comps), ("E", []), ("F", None)], page)
    base_file = T.FILE_PATH
    assert pages.select(T.image_urls(F.col("comp_data")).alias("u")).first().u == sorted(
        [f"{base}/gone/F g.svg", f"{base}/ok/F g.svg", base_file + "B c.JPG", "https://h.org/e.png", base_file + "R é.png"]
    )
    none = spark.createDataFrame([("B c.jpg",), ("e.png",), ("R é.png",)], "name string")
    made = {r.url: r for r in pipelines.crawl_images(pages, none, web.HttpFetcher(), web.Pace(tries=1)).collect()}
    assert {u.removeprefix(base): (r.name, bytes(r.content).decode()) for u, r in made.items()} == {
        "/gone/F g.svg": ("F g.svg", "<p>/FilePath/F g.svg</p>"), "/ok/F g.svg": ("F g.svg", "<p>/ok/F g.svg</p>"),
    }

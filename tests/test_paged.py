"""The paged source against a search service on this machine: what is asked of it, and that pushed reads equal unpushed ones."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siltstone.sources import paged
from siltstone.streaming import streams

SCHEMA = "id string, type string, n int, date string, thematic array<string>, text string"


@pytest.fixture()
def service():
    """Answers term, terms, range and exists queries over rows, and remembers what it was asked."""
    rows, asked, fail = [], [], []

    def holds(row, clause):
        kind, body = next(iter(clause.items()))
        if kind == "exists":
            return row.get(body["field"]) is not None
        field, value = next(iter(body.items()))
        have = row.get(field)
        if kind == "range":
            return have is not None and all({"gt": have > v, "gte": have >= v, "lt": have < v, "lte": have <= v}[k] for k, v in value.items())
        return bool(set(have if isinstance(have, list) else [have]) & set(value if kind == "terms" else [value]))

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            p = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if fail:
                fail.pop()
                self.send_error(503)
                return
            asked.append(p)
            hits = [r for r in rows if all(holds(r, c) for c in p.get("query", {}).get("bool", {}).get("must", []))]
            for s in reversed(p.get("sort", [])):
                field, how = next(iter(s.items()))
                hits.sort(key=lambda r: r[field], reverse=how["order"] == "desc")
            page = [{"_source": {k: r[k] for k in p["_source"] if k in r}} for r in hits[p["from"] : p["from"] + p["size"]]] if p["size"] else []
            body = json.dumps({"hits": {"total": {"value": len(hits)}, "hits": page}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/search", rows, asked, fail
    server.shutdown()


def fill(rows, n, first=0):
    rows += [{"id": f"d{i}", "type": ("case", "law", "order")[i % 3], "n": i, "date": f"20{i % 30:02d}-01-01", "thematic": ["work"] if i % 2 else ["tax", "home"], "text": f"t{i}"} | ({} if i % 5 else {"extra": 1}) for i in range(first, first + n)]


def load(spark, url, schema=SCHEMA, **options):
    paged.register(spark)
    r = spark.read.format("paged").schema(schema).option("url", url).option("size", "10").option("wait", "0.01")
    for k, v in options.items():
        r = r.option(k.replace("__", "."), v)
    return r.load()


def test_filters_and_columns_reach_the_service(spark, service):
    url, rows, asked, _ = service
    fill(rows, 95)
    got = load(spark, url, "id string, type string, n int").where("type in ('case', 'law') and n >= 30 and n < 60 and id like '%1'").orderBy("n").collect()
    assert [r.id for r in got] == [r["id"] for r in rows if r["type"] != "order" and 30 <= r["n"] < 60 and r["id"].endswith("1")]
    pages = [p for p in asked if p["size"]]
    must = pages[0]["query"]["bool"]["must"]
    assert {"terms": {"type": ["case", "law"]}} in must and {"range": {"n": {"gte": 30}}} in must and {"range": {"n": {"lt": 60}}} in must
    assert {p["from"] for p in pages} == {0, 10} and {tuple(p["_source"]) for p in pages} == {("id", "type", "n")}


@pytest.mark.parametrize("where", ["type = 'case'", "type <> 'case'", "n > 90 or type = 'law'", "n is not null and n = 7", "type is null", "arrays_overlap(thematic, array('home'))", "type = 'law' and text = 't4'", "false"])
def test_pushed_equals_unpushed(spark, service, where):
    url, rows, _, _ = service
    fill(rows, 95)
    whole = spark.createDataFrame([tuple(r.get(c) for c in ("id", "type", "n", "date", "thematic", "text")) for r in rows], SCHEMA)
    assert sorted(r.id for r in load(spark, url).where(where).collect()) == sorted(r.id for r in whole.where(where).collect())


def test_lists_order_and_retries(spark, service):
    url, rows, asked, fail = service
    fill(rows, 45)
    fail += [1, 1]
    got = load(spark, url, terms__thematic="home,none", sort="date desc,n").collect()
    assert [r.id for r in got] == [r["id"] for r in sorted((r for r in rows if "home" in r["thematic"]), key=lambda r: (r["date"], -r["n"]), reverse=True)]
    assert {"terms": {"thematic": ["home", "none"]}} in asked[-1]["query"]["bool"]["must"]
    fail += [1] * 100
    with pytest.raises(Exception, match="503"):
        load(spark, url, tries="2").count()
    fail.clear()
    assert load(spark, url, "id string").where("id = 'none'").count() == 0


def test_pages_of_a_file_read_their_own_lines(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text("".join(json.dumps({"id": f"é{i}", "text": "x" * (i % 7)}) + ("\n\n" if i % 4 == 0 else "\n") for i in range(25)))
    client = paged.FileClient(str(path))
    pages = client.pages([], 10)
    assert [(p.start, p.size) for p in pages] == [(0, 10), (10, 10), (20, 10)] and client.count([]) == 25
    assert [r["id"] for p in pages for r in client.fetch(p, [], [], [])] == [f"é{i}" for i in range(25)]
    path.write_bytes(b"\xff" * pages[1].place + path.read_bytes()[pages[1].place :])  # another page's bytes do not matter
    assert [r["id"] for r in client.fetch(pages[1], [], [], [])] == [f"é{i}" for i in range(10, 20)]
    with pytest.raises(ValueError, match="no query"):
        paged.Listing({"path": str(path), "sort": "id"}, spark.range(1).schema)


def listed(spark, url):
    paged.register(spark)
    return spark.readStream.format("paged").schema("id string, n int").option("url", url).option("size", "10").load()


def test_a_killed_crawl_goes_on_where_it_was(spark, service, tmp_path):
    url, rows, asked, _ = service
    out = f"file://{tmp_path}/out"
    fill(rows, 35)
    assert streams.crawl(listed(spark, url), out).count() == 35
    fill(rows, 20, 35)

    def dies(batch, number):
        batch.limit(3).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        listed(spark, url).writeStream.foreachBatch(dies).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    asked.clear()
    fill(rows, 12, 55)
    got = streams.crawl(listed(spark, url), out).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert min(p["from"] for p in asked if p["size"]) == 35  # nothing that was committed is fetched again
    assert {(r.id, r.n) for r in got} == {(f"d{i}", 1) for i in range(67)}
    assert streams.crawl(listed(spark, url), out).count() == 67


def test_crawl_adds_what_is_new(spark, service, tmp_path):
    url, rows, _, _ = service
    assert streams.crawl(listed(spark, url), f"file://{tmp_path}/out").count() == 0
    fill(rows, 25)
    assert streams.crawl(listed(spark, url), f"file://{tmp_path}/out").count() == 25
    fill(rows, 5, 25)
    assert sorted(r.n for r in streams.crawl(listed(spark, url), f"file://{tmp_path}/out").collect()) == list(range(30))

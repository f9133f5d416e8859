import datetime as dt
import io
import json

import pytest

from lectern import config
from lectern.cli import main
from lectern.engine import Engine
from lectern.operators import route, search
from lectern.rpc import Server, tools
from lectern.sources import live, payloads, transport
from lectern.sources.transport import Response, SourceError

from . import fixtures as fx


def test_paging():
    items = list(range(250))
    calls = []

    def fetch(cursor, size):
        calls.append((cursor, size))
        at = 0 if cursor == "*" else int(cursor)
        return items[at : at + size], str(at + size)

    assert [*transport.cursor_pages(fetch, 120, 100)] == items[:120] and calls == [("*", 100), ("100", 100)]
    assert [*transport.cursor_pages(lambda c, n: ([1], "*"), 10, 100)] == [1] and [*transport.cursor_pages(lambda c, n: None, 10, 100)] == []
    assert [*transport.offset_pages(lambda at, n: items[at : at + n][:60], 500, 100)] == items[:60]
    assert [*transport.counted_pages(lambda at: (items[at : at + 100], 250))] == items


def test_retries():
    seen, slept = [Response(429, b"", {"Retry-After": "7"}), Response(503, b"", {}), Response(200, b"ok", {})], []
    assert transport.with_retries(lambda: seen.pop(0), sleep=slept.append).body == b"ok" and slept == [7.0, 1.1]
    assert transport.with_retries(lambda: Response(500, b"", {}), 2, slept.append).status == 500
    with pytest.raises(OSError):
        transport.with_retries(lambda: (_ for _ in ()).throw(OSError()), 1, slept.append)
    with pytest.raises(SourceError):
        transport.require_key(None)


def test_config(tmp_path):
    (tmp_path / ".env").write_text("LECTERN_CHUNK_TOKENS=100\nCONTACT_EMAIL='a@b'\n")
    (tmp_path / "t.toml").write_text('chunk_tokens = 5\nchunk_overlap = 6\ncross_section = true\nunknown = 1\n')
    s = config.load_settings({"LECTERN_CHUNK_OVERLAP": "7", "AWS_REGION": "eu"}, tmp_path / ".env", tmp_path / "t.toml", tokenizer="regex:x")
    assert (s.chunk_tokens, s.chunk_overlap, s.cross_section, s.contact_email, s.aws_region, s.tokenizer) == (100, 7, True, "a@b", "eu", "regex:x")
    assert "a@b" in s.user_agent and s.bucket_for("medrxiv") == "medrxiv-src-monthly"
    for bad in (lambda: s.bucket_for("x"), lambda: config.Settings(chunk_tokens=0)):
        with pytest.raises(ValueError):
            bad()


def test_queries_for_catalogs():
    q = search.field_query
    assert q("a b", "title") == '(TITLE:"a" AND TITLE:"b")' and q("a", "abstract") == 'ABSTRACT:"a"' and q("A B", "author") == 'AUTH:"A B"' and q("a b") == "a b"
    assert q("a b", "title", "arxiv") == "(ti:a AND ti:b)" and q("a", "fulltext", "arxiv") == "all:a" and q("A", "author", "arxiv") == 'au:"A"'
    assert q("a b", "abstract", "openalex") == "abstract.search:a b" and q("a", "fulltext", "openalex") == "a"


def test_search_and_discover(spark):
    day = lambda m: dt.date(2024, m, 1)
    df = spark.createDataFrame([(1, "Cell cell membrane", day(1), "bio"), (2, "Membrane", day(2), "bio"), (3, "cell, membrane", day(3), None)], "doi int, text string, date date, category string")
    assert [(r.doi, r.score) for r in search.search(df, "CELL membrane", {"fulltext": "text"}, "doi").collect()] == [(1, 3.0), (3, 2.0)]
    assert [r.doi for r in search.discover(df, "membrane", "bio", since=dt.date(2024, 1, 1), until=dt.date(2024, 2, 1)).collect()] == [1, 2]
    assert search.discover(df, until=dt.date(2023, 1, 1)).count() == 0


def test_feed(spark):
    rows = payloads.arxiv_metadata(spark.createDataFrame([(fx.FEED,), ("broken <",)], "xml string")).orderBy("place").collect()
    assert [(r.doi, r.version, r.title, r.date) for r in rows] == [("10.48550/arXiv.2401.10515", 2, "A wide title", dt.date(2024, 1, 19)), ("10.48550/arXiv.9901001", None, None, None)]
    assert rows[0].authors == ["Gi"] and rows[0].category == "cs.CL" and rows[0].abstract == "Some text" and rows[0].published_doi == "10.9/j"


def test_details(spark):
    page = json.dumps({"collection": [{"doi": "10.1/a", "version": "1", "authors": "A, B.; C", "date": "2024-01-02", "license": "cc_by", "published": "NA"}, {"doi": "10.1/a", "version": "x", "date": "bad", "published": "10.2/p"}]})
    v = payloads.detail_versions(spark.createDataFrame([(page, "medrxiv")], "json string, server string"))
    a, b = v.orderBy("place").collect()
    assert (a.version, a.date, a.authors, a.license.spdx_id, a.published_doi) == (1, dt.date(2024, 1, 2), ["A, B.", "C"], "CC-BY", None) and (b.version, b.date, b.published_doi) == (None, None, "10.2/p")
    assert payloads.latest_details(v).first().published_doi == "10.2/p"
    day = dt.date(2024, 1, 2)
    assert payloads.details_window(v, "medrxiv", day, day).count() == 1


def test_archive_keys(spark):
    keys = ["Current_Content/October_2025/a.meca", "Current_Content/May_2025/b.meca", "Current_Content/odd/c.meca", "Current_Content/June_2025/d.zip", "Back_Content/Batch_01/e.meca", "Current_Content/f.meca"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = lambda **o: "".join(sorted(r.key[-6] for r in payloads.archive_keys(df, **o).collect()))
    assert got() == "abcf" and got(since=dt.date(2025, 6, 20)) == "acf" and got(include_back_content=True) == "abcef"


def test_archive_lookup(spark):
    rows = [("Current_Content/June_2025/a.meca", fx.archive(fx.JATS.encode())), ("Current_Content/May_2025/b.meca", b"never opened")]
    files = spark.createDataFrame(rows, "key string, content binary")
    asked = spark.createDataFrame([("10.1101/2025.06.03.111", 2), ("10.1101/2025.06.09.5", None)], "doi string, version int")
    got = payloads.archive_lookup(files, asked, "b", "medrxiv").collect()
    assert [(r.doi, r.version, r.server, r.raw_ref) for r in got] == [("10.1101/2025.06.03.111", 2, "medrxiv", "s3://b/Current_Content/June_2025/a.meca")]


def test_arxiv_prefers_the_native_page(spark):
    cols = "arxiv_id string, version int, url string, html string"
    native = spark.createDataFrame([("1", 2, "n1", fx.LATEXML), ("2", None, "n2", "<html></html>")], cols)
    mirror = spark.createDataFrame([("1", 2, "m1", fx.LATEXML), ("2", None, "m2", fx.LATEXML.replace("Cy Dee", ""))], cols)
    pages = spark.createDataFrame([("2", "x creativecommons.org/licenses/by/4.0/ y")], "arxiv_id string, html string")
    meta = payloads.arxiv_metadata(spark.createDataFrame([(fx.FEED.replace("2401.10515", "2"),)], "xml string"))
    a, b = sorted(payloads.arxiv_fulltext(native, mirror, pages, meta).collect(), key=lambda r: r.doi)
    assert (a.raw_ref, a.provenance["backend"], a.license.spdx_id, a.authors) == ("n1", "native", None, ["Cy Dee"])
    assert (b.raw_ref, b.provenance["backend"], b.license.spdx_id, b.authors, b.version, b.category) == ("m2", "ar5iv", "CC-BY-4.0", ["Gi"], 2, "cs.CL")


def test_routing(spark):
    a = spark.createDataFrame([("x", 1)], "doi string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 2)], "doi string, v int")
    got = {r.doi: (r.v, r.retrieved, r.tried) for r in route.first_source([("a", a), ("b", b)], "doi").collect()}
    assert got == {"x": (1, "a", ["a"]), "y": (2, "b", ["a", "b"])}
    want = spark.createDataFrame([("x",), ("y",), ("z",)], "doi string")
    got = {r.doi: (r.v, r.retrieved, r.tried) for r in route.staged_route(want, [("a", lambda d: a.join(d, "doi")), ("b", lambda d: b.join(d, "doi"))]).collect()}
    assert got == {"x": (1, "a", ["a"]), "y": (2, "b", ["a", "b"]), "z": (None, None, ["a", "b"])}
    docs = spark.createDataFrame([("x", None, "c"), ("q", 1, None)], "doi string, version int, category string")
    meta = spark.createDataFrame([("x", 3, "d")], "doi string, version int, category string")
    for limit in (0, 100):
        assert sorted((r.doi, r.version, r.category) for r in route.enrich(docs, meta, "doi", ["version", "category"], limit).collect()) == [("q", 1, None), ("x", 3, "c")]


DOI = "10.1101/2025.06.03.111"


def catalog(url, params):
    """A transport with one paper in every catalog."""
    ok = lambda body: Response(200, body if isinstance(body, bytes) else body.encode(), {}, url)
    if url.endswith("/search") and "none" in params["query"]:
        return ok("{}")
    if url.endswith("/search"):
        hit = {"source": "PPR", "id": "PPR1", "doi": "10.1101/2025.06.03.111", "title": "T", "inEPMC": "Y"}
        return ok(json.dumps({"resultList": {"result": [hit] if params["cursorMark" if "cursorMark" in params else "pageSize"] in ("*", 1) else []}, "nextCursorMark": "*"}))
    if url.endswith("PPR1/fullTextXML"):
        return ok(fx.JATS)
    if "/details/biorxiv/10.1101/2025.06.03.111" in url:
        return ok(json.dumps({"collection": [{"doi": "10.1101/2025.06.03.111", "version": "1"}, {"doi": "10.1101/2025.06.03.111", "version": "2", "date": "2025-06-03", "category": "cells", "published": "10.9/p"}]}))
    if "/html/2401.10515" in url:
        return ok(fx.LATEXML)
    if "export.arxiv.org" in url:
        return ok(fx.FEED)
    if url.endswith(".full"):
        return Response(200, fx.JOURNAL.encode(), {}, url.replace(".full", "v4.full"))
    if url.endswith("/works") or "/works/" in url:
        work = {"id": "https://openalex.org/W1", "doi": "https://" + "doi.org/10.1/w", "title": "W", "abstract_inverted_index": {"hi": [0]}}
        return ok(json.dumps(work if "/works/" in url else {"results": [work], "meta": {}}))
    return Response(404, b"", {}, url)


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, config.Settings(openalex_api_key="k"), catalog)


def test_engine_fulltext(engine, spark):
    row, tried, why = engine.fulltext("www.biorxiv.org/content/" + DOI + "v2.full")
    assert tried == ["europepmc"] and why is None and (row["version"], row["category"], row["published_doi"], row["server"]) == (2, "cells", "10.9/p", "medrxiv")
    row, tried, why = engine.fulltext("10.1101/2025.06.03.111", version=1)
    assert row is None and tried == [] and "--html" in why  # an old version isn't on Europe PMC
    row, tried, _ = engine.fulltext("10.1101/2025.06.03.111", version=1, allow_html=True)
    assert tried == ["biorxiv_html"] and row["version"] == 1 and row["retrieved_from"] == "biorxiv_html"
    files = spark.createDataFrame([("Current_Content/June_2025/a.meca", fx.archive(fx.JATS.encode()))], "key string, content binary")
    row, tried, _ = engine.fulltext("10.1101/2025.06.03.111", 1, archives=files)
    assert tried == ["biorxiv_s3"] and row["version"] == 1
    row, tried, _ = engine.fulltext("arXiv:2401.10515v2")
    assert tried == ["arxiv_html"] and row.doi == "10.48550/arXiv.2401.10515" and row.version == 2
    assert engine.fulltext("10.5/none")[0] is None and engine.fulltext("x", source="odd")[2] == "unknown source 'odd'"
    assert engine.fulltext("10.1101/2025.06.03.111", source="s3")[2] == "the archives need credentials"


def test_engine_search_and_resolve(engine, spark):
    assert [r.title for r in engine.search("t", "europepmc", "title").collect()] == ["T"]
    assert [r.openalex_id for r in engine.search("t", "openalex").collect()] == ["W1"] and engine.search("t", "arxiv", limit=1).count() == 1
    assert engine.discover("t", "c", dt.date(2024, 1, 1), None, "openalex").first().snippet == "hi"
    assert engine.discover("t", source="arxiv", limit=5).count() == 2 and engine.discover("t", source="europepmc").count() == 1
    assert engine.resolve("10.1101/2025.06.03.111")["ppr_id"] == "PPR1" and engine.resolve("https://openalex.org/W1")["doi"] == "10.1/w"
    with pytest.raises(SourceError):
        engine.search("t", "odd")
    with pytest.raises(SourceError):
        Engine(spark, config.Settings(), catalog).search("t", "openalex")


def test_cli(engine, tmp_path, capsys):
    assert main(["version"]) == 0 and capsys.readouterr().out.strip() == "0.1.0"
    assert main(["get", "10.1101/2025.06.03.111", "-m"], engine) == 0 and capsys.readouterr().out.startswith("# On things, briefly")
    assert main(["get", "10.1101/2025.06.03.111", "-o", str(tmp_path / "o.json")], engine) == 0
    assert json.loads((tmp_path / "o.json").read_text())["doi"] == "10.1101/2025.06.03.111"
    assert main(["get", "10.5/none"], engine) == 2 and "No full text" in capsys.readouterr().err
    assert main(["search", "q", "-n", "1"], engine) == 0 and json.loads(capsys.readouterr().out)["title"] == "T"
    assert main(["search", "q", "--source", "odd"], engine) == 2 and main(["discover", "--since=2024-01", "--query", "x"], engine) == 0
    assert main(["ingest", str(tmp_path / "c"), "--source", "arxiv"], engine) == 2 and main(["ingest", str(tmp_path / "c"), "--source", "odd"], engine) == 2
    capsys.readouterr()
    assert main(["ingest", "--source", "europepmc", str(tmp_path / "c"), "-n5"], engine) == 0
    assert json.loads(capsys.readouterr().err.splitlines()[-1])["processed"] == 1
    folder = tmp_path / "in" / "Current_Content" / "June_2025"
    folder.mkdir(parents=True)
    (folder / "a.meca").write_bytes(fx.archive(fx.JATS.encode()))
    assert main(["ingest", str(tmp_path / "d"), "--root", str(tmp_path / "in"), "--redistribution", "--format", "parquet"], engine) == 0


def test_rpc(engine):
    server = Server(tools(engine))
    ask = lambda method, **params: server.dispatch(dict(id=1, jsonrpc="2.0", method=method, params=params))
    spoken = lambda **p: ask("initialize", **p)["result"]["protocolVersion"]
    assert spoken(protocolVersion="2024-11-05") == "2024-11-05" and spoken() == "2025-06-18"
    assert ask("ping")["result"] == {} and [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["search_preprints", "get_fulltext", "get_metadata", "resolve"]
    call = lambda name, **a: ask("tools/call", name=name, arguments=a)
    assert call("search_preprints", query="q")["result"]["structuredContent"]["result"][0]["title"] == "T"
    assert call("get_fulltext", doi="10.5/none")["result"]["isError"] and call("get_metadata", doi="10.1101/2025.06.03.111")["result"]["structuredContent"]["version"] == 2
    assert call("get_fulltext", doi="10.1101/2025.06.03.111", as_markdown=True)["result"]["content"][0]["text"].startswith("# On")
    assert call("nope")["error"]["code"] == call("resolve")["error"]["code"] == -32602 and ask("odd")["error"]["code"] == -32601
    assert server.dispatch({"method": "notifications/initialized"}) is None and server.dispatch({"method": "odd"}) is None
    out = io.BytesIO()
    server.serve(io.BytesIO(b'\n{bad\n{"id": 2, "method": "ping"}\n'), out)
    assert [json.loads(x).get("error", {}).get("code") for x in out.getvalue().splitlines()] == [-32700, None]
    assert call("search_preprints", query="q", source="odd")["result"]["isError"]


def test_data_source_reader():
    r = live._Reader({"catalog": "europepmc", "query": "q", "limit": "1"}, catalog)
    assert json.loads(next(r.read(r.partitions()[0]))[0])["id"] == "PPR1"
    with pytest.raises(SourceError):
        live._Reader({"catalog": "openalex"}, catalog)
    assert [i["id"] for i in live.epmc_items(catalog, "q", 5)] == ["PPR1"] and len([*live.feed_pages(catalog, "https://export.arxiv.org/api/query", "all:q", 2)]) == 2


def test_epmc(spark):
    rows = spark.createDataFrame([("10.1/a", 1, "P1", "u", fx.JATS), ("10.1/b", None, "P2", "v", "<article/>")], "doi string, version int, ppr_id string, url string, xml string")
    got = payloads.epmc_fulltext(rows).collect()
    assert [(r.doi, r.version, r.server, r.raw_ref, r.provenance["europepmc_id"]) for r in got] == [("10.1/a", 1, "medrxiv", "u", "P1")]
    page = json.dumps({"resultList": {"result": [{"source": "MED", "id": "1", "doi": "10.1/a"}, {"source": "PPR", "id": "P", "doi": "10.1/a"}, {"source": "PPR", "id": "Q", "doi": "10.1/a"}]}})
    assert [(r.doi, r.ppr_id) for r in payloads.epmc_ids(spark.createDataFrame([(page,)], "json string")).collect()] == [("10.1/a", "P")]


def test_details_are_read_by_day_and_arxiv_by_entry(spark):
    asked = []

    def get(url, params):
        asked.append(url)
        return Response(200, json.dumps({"collection": [{"doi": url.rsplit("/", 2)[1]}], "messages": [{"total": 1}]}).encode(), {}) if "details" in url else Response(200, fx.FEED.encode(), {})

    reader = live._Reader({"catalog": "details", "since": "2025-01-30", "until": "2025-02-02"}, get)
    parts = reader.partitions()
    assert [p.value for p in parts] == ["2025-01-30", "2025-01-31", "2025-02-01", "2025-02-02"]
    assert [json.loads(x)["doi"] for p in parts for (x,) in reader.read(p)] == [p.value for p in parts] and all("/2025-01-30/2025-01-30/" in u for u in asked[:1])
    entries = [json.loads(x) for (x,) in live._Reader({"catalog": "arxiv", "query": "all:x", "limit": "1"}, get).read(None)]
    assert len(entries) == 1 and "2401.10515" in entries[0]["id"]


def test_one_work(spark):
    from lectern.config import Settings
    from lectern.engine import Engine

    body = {"id": "https://openalex.org/W7", "doi": "https://doi.org/10.1/x", "title": "", "display_name": "Shown", "abstract_inverted_index": {"b": [1], "a": [0]}}
    engine = Engine(spark, Settings(openalex_api_key="k"), lambda url, params: Response(200 if url.endswith("W7") else 404, json.dumps(body).encode(), {}))
    r = engine.work("https://openalex.org/W7").first()
    assert (r.doi, r.title, r.abstract, r.provenance["openalex_id"]) == ("10.1/x", "Shown", "a b", "W7")
    assert engine.work("W8").count() == 0 and engine.resolve("W7")["doi"] == "10.1/x" and engine.resolve("W8")["doi"] is None


def test_scratch_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from lectern.session import scratch_dir

    on = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch_dir(on(master))
    assert scratch_dir(on("local[4]")).startswith("file:/")

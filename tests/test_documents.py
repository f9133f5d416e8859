import shutil
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import assemble, chunk
from lectern.operators.gate import gate
from lectern.operators.tokenizers import pieces
from lectern.parse.articles import archive_article, parse_jats, parse_journal_page, parse_latexml
from lectern.parse.tree import parse_html, parse_xml
from lectern.parse.udfs import parsed
from lectern.plans.ingest import ingest, manifest_path, read_table
from lectern.schemas import CHUNK, FULLTEXT, MANIFEST
from lectern.config import Settings
from lectern.sources import payloads

from . import fixtures as fx


def test_jats():
    a = parse_jats(fx.JATS)
    assert a["title"] == "On things, briefly" and a["doi"] == "10.1101/2025.06.03.111" and a["authors"] == ["Bo Alder"]
    assert a["abstract"] == "We did it []." and a["license_raw"]["href"].endswith("licenses/by/4.0/") and a["license_raw"]["text"] == "Open"
    assert [(s["order"], s["kind"], s["title"], s["text"]) for s in a["sections"]] == [(1, "intro", "Start", "A b c d."), (2, "intro", None, "Nested inherits."), (3, "methods", "Materials & such", "How.")]
    assert "GONE" not in json.dumps(a) and "CELL" in parse_jats(fx.JATS, keep_tables=True)["sections"][2]["text"]


@pytest.mark.parametrize("cut", [0, 5, 300, 900, 1200, 1500])
def test_jats_never_raises(cut):
    for data in (fx.JATS[:cut], fx.JATS.replace("</p>", ""), fx.JATS.replace("&amp;", "&nbsp;&bogus;"), b"\xff\xfe\x00", None, "no xml", "<a><b></a></b>"):
        assert isinstance(parse_jats(data)["sections"], list)
    assert parse_jats(fx.JATS.replace("</sec></body>", "</body>"))["sections"][0]["text"] == "A b c d."


def test_pages():
    a = parse_latexml(fx.LATEXML)
    assert a["title"] == "A Title" and a["authors"] == ["Cy Dee"] and a["abstract"] == "Short tale."
    assert [(s["kind"], s["title"], s["text"]) for s in a["sections"]] == [("intro", "Introduction", "One two."), ("intro", "Detail", "Deep. Deeper.")]
    b = parse_journal_page(fx.JOURNAL)
    assert b["title"] == "Page title" and b["authors"] == ["E. Eff"] and b["abstract"] == "Own abstract."
    assert [(s["order"], s["title"], s["text"]) for s in b["sections"]] == [(1, "Results", ""), (2, None, "Found, it."), (3, "More", "And more.")]
    assert "GONE" not in json.dumps([a, b]) and parse_latexml(b"")["sections"] == parse_journal_page(None)["sections"] == []


def test_trees():
    assert parse_html("<p>a<p>b<br>c</div>").text() == "abc" and parse_xml("") is None and parse_html("") is None
    assert parse_xml("<a>x<b/>y</a>").text() == "xy" and parse_xml("<a>&eacute;</a>").text() == "é"


def test_archives():
    xml = fx.JATS.encode()
    assert archive_article(fx.archive(xml)) == xml
    assert archive_article(fx.archive(b"<x/>", "content/s.xml", False, big=xml)) == xml
    assert archive_article(b"not a zip") is None and archive_article(None) is None
    assert archive_article(fx.archive(b"pdf", "content/a.pdf", False)) is None


def papers(spark, **more):
    rows = spark.createDataFrame([(fx.JATS, "t1"), (fx.JATS.replace("2025.06.03.111", "2025.06.03.222").replace("licenses/by/4.0", "none"), "t2")], "xml string, target_id string")
    return assemble.build_fulltext(rows.withColumn("parsed", parsed("xml", "jats")), source="biorxiv_s3", raw_ref=F.lit("s3://b/k"), **more).drop("xml")


def test_assembly(spark):
    docs = papers(spark, provenance=F.create_map(F.lit("source"), F.lit("x")))
    assert {f.name for f in FULLTEXT} <= set(docs.columns)
    r = docs.where("target_id = 't1'").first()
    assert [(s.id, s.kind, s.title, s.order) for s in r.sections] == [("1", "abstract", "Abstract", 1), ("2", "intro", "Start", 2), ("3", "intro", None, 3), ("4", "methods", "Materials & such", 4)]
    assert r.license.spdx_id == "CC-BY-4.0" and r.doi == "10.1101/2025.06.03.111" and r.version is None
    md = assemble.markdown(docs.where("target_id = 't1'")).first().markdown
    assert md.startswith("# On things, briefly\n\n**DOI:** 10.1101/2025.06.03.111  \n") and "## Abstract\n\nWe did it [].\n\n## Start" in md and "## Intro\n" in md and md.endswith("How.\n")


def test_rebuilt_abstract(spark):
    df = spark.createDataFrame([({"a": [0, 2], "b": [1]},), ({},), (None,)], "m map<string,array<int>>")
    assert [r.t for r in df.select(assemble.rebuilt_abstract("m").alias("t")).collect()] == ["a b a", None, None]


@pytest.mark.parametrize("mode", ["analysis", "redistribution"])
def test_gate(spark, mode):
    said = []
    rows = {r.target_id: r for r in gate(papers(spark), mode, said.append).collect()}
    assert len(said) == (mode == "analysis") and not rows["t1"].degraded and len(rows["t1"].sections) == 4
    assert rows["t2"].degraded == (mode == "redistribution")
    if mode == "redistribution":
        assert rows["t2"].sections == [] and rows["t2"].abstract is None and rows["t2"].provenance == {"degraded": "true", "oa_url": "s3://b/k"} and rows["t2"].title
    with pytest.raises(ValueError):
        gate(papers(spark), "other")


TEXTS = ["", "  ", "one", " lead and trail \n", "a b c d e f g h i j", "x " * 1000, "é😀 ß z " * 7]


@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (3, 1), (4, 9), (512, 64)])
@pytest.mark.parametrize("spec", ["ws", r"regex:\w+"])
def test_windows(spark, size, overlap, spec):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    rows = {}
    for r in chunk.windows(df, "text", size, overlap, spec).collect():
        rows.setdefault(r.i, []).append(r)
    tokens = {r.i: r.p for r in df.select("i", pieces("text", spec).alias("p")).collect()}
    for i, t in enumerate(TEXTS):
        n, step = len(tokens[i]), max(1, size - overlap)
        if n:
            assert "".join(tokens[i]) == t
        got = sorted(rows.get(i, []), key=lambda r: r.idx)
        assert len(got) == (0 if n == 0 else 1 + -(-max(0, n - size) // step))
        assert all(r.chunk_text == t[r.char_start : r.char_end] and 0 < r.token_count <= size for r in got)
        assert not got or (got[0].char_start == 0 and got[-1].char_end == len(t))


def test_tokenizer_from_a_rank_file(spark, tmp_path):
    import base64

    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + f" {i}".encode() for i in range(256)))
    df = spark.createDataFrame([("hé 😀",)], "t string")
    p = df.select(pieces("t", f"tiktoken:{path}").alias("p")).first().p
    assert "".join(p) == "hé 😀" and len(p) == len("hé 😀".encode())
    with pytest.raises(ValueError):
        pieces("t", "other:x")


def test_chunks(spark):
    rows = chunk.chunk_fulltext(papers(spark), 3, 1).collect()
    mine = [r for r in rows if r.doi.endswith("111")]
    assert {r.chunk_id for r in mine} == {f"10.1101/2025.06.03.111:na:{o}:{k}" for o, n in ((1, 2), (2, 2), (3, 1), (4, 1)) for k in range(n)}
    assert all(r.license.redistributable == r.doi.endswith("111") for r in rows)
    cross = sorted((r.char_start, r.chunk_id, r.section_kind) for r in chunk.chunk_fulltext(papers(spark), 4, 0, cross_section=True).collect() if r.doi.endswith("111"))
    assert [k for *_, k in cross] == ["abstract", "abstract", "intro"] or cross[0][2] == "abstract"
    assert cross[0][1] == "10.1101/2025.06.03.111:na:x:0"


def write_archives(root, n=4, start=0):
    for i in range(start, start + n):
        folder = root / "Current_Content" / ("May_2025" if i == 0 else "June_2025")
        folder.mkdir(parents=True, exist_ok=True)
        xml = fx.JATS.replace("06.03.111", f"06.03.{i}").replace("licenses/by/4.0", "none" if i % 2 else "licenses/by/4.0")
        (folder / f"{i}.meca").write_bytes(fx.archive(xml.encode()))
    (root / "Current_Content" / "June_2025").mkdir(exist_ok=True)
    (root / "Current_Content" / "June_2025" / "broken.meca").write_bytes(b"no zip")


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_ingest_resumes(spark, tmp_path, fmt):
    write_archives(tmp_path / "in")
    out = str(tmp_path / "corpus")

    def targets():
        return payloads.read_archives(spark, str(tmp_path / "in")).withColumn("target_id", F.concat(F.lit("biorxiv:"), "key"))

    load = lambda df: payloads.archive_fulltext(df, "b", "biorxiv").drop("key")
    run = lambda: ingest(spark, targets(), load, out, "redistribution", Settings(), fmt).as_dict()
    first = run()
    assert (first["processed"], first["degraded"], first["not_found"], first["n_chunks"], first["skipped"]) == (4, 2, 1, 8, 0)
    again = run()
    assert (again["processed"], again["n_chunks"], again["skipped"]) == (0, 0, 5)
    write_archives(tmp_path / "in", 1, 8)
    more = run()
    assert (more["processed"], more["skipped"], more["n_chunks"]) == (1, 5, 4)
    corpus = read_table(spark, out, CHUNK, fmt)
    assert corpus.count() == corpus.select("chunk_id").distinct().count() == 12 and not corpus.where("not license.redistributable").count()
    rows = read_table(spark, manifest_path(out), MANIFEST, fmt).collect()
    assert sorted(r.status for r in rows) == ["degraded"] * 2 + ["not_found"] + ["ok"] * 3


def test_ingest_after_a_crash_before_the_manifest(spark, tmp_path):
    """Chunks without manifest rows: the next run writes none twice and still counts them."""
    write_archives(tmp_path / "in", 1)
    out = str(tmp_path / "corpus")
    targets = payloads.read_archives(spark, str(tmp_path / "in")).withColumn("target_id", F.col("key"))
    load = lambda df: payloads.archive_fulltext(df, "b", "biorxiv").drop("key")
    ingest(spark, targets, load, out)
    shutil.rmtree(manifest_path(out))
    assert ingest(spark, targets, load, out).n_chunks == 4 and read_table(spark, out, CHUNK).count() == 4


def test_repeated_targets_are_done_once(spark, tmp_path):
    write_archives(tmp_path / "in", 2)
    out = str(tmp_path / "corpus")
    listed = payloads.list_archives(spark, str(tmp_path / "in")).withColumn("target_id", F.col("key"))
    load = lambda df: payloads.archive_fulltext(payloads.opened(df), "b", "biorxiv").drop("key")
    r = ingest(spark, listed.union(listed).union(listed.where("key like '%/0.meca'")), load, out)
    assert (r.processed, r.skipped, r.not_found, r.n_chunks) == (2, 4, 1, 8)
    rows = read_table(spark, manifest_path(out), MANIFEST).collect()
    assert sorted((r.status, r.n_chunks) for r in rows) == [("not_found", 0), ("ok", 4), ("ok", 4)]
    # other targets of a DOI that is in the corpus: its chunks aren't written again
    again = ingest(spark, listed.withColumn("target_id", F.concat(F.lit("x"), "key")), load, out)
    assert (again.processed, again.skipped, again.n_chunks) == (2, 0, 8) and read_table(spark, out, CHUNK).count() == 8


def test_corpus_is_read_only_where_it_can_hold_the_chunks(spark, tmp_path):
    """A run over new DOIs doesn't open the corpus: it succeeds though the corpus can't be read."""
    out = tmp_path / "corpus"
    load = lambda df: payloads.archive_fulltext(payloads.opened(df), "b", "biorxiv").drop("key")
    write_archives(tmp_path / "in", 2)
    targets = lambda: payloads.list_archives(spark, str(tmp_path / "in")).where("key not like '%broken%'").withColumn("target_id", F.col("key"))
    ingest(spark, targets(), load, str(out))
    for f in out.glob("*.parquet"):
        f.write_bytes(b"unreadable")
    for f in out.glob(".*.crc"):
        f.unlink()
    write_archives(tmp_path / "in", 1, 7)
    assert ingest(spark, targets(), load, str(out)).n_chunks == 4
    (tmp_path / "corpus_manifest_open").write_text("")  # a run that died has left its mark
    write_archives(tmp_path / "in", 1, 8)
    with pytest.raises(Exception, match="(?i)parquet"):
        ingest(spark, targets(), load, str(out))


def test_other_months_are_not_touched(spark, tmp_path):
    write_archives(tmp_path / "in", 3)
    (tmp_path / "in" / "Current_Content" / "May_2025" / "0.meca").chmod(0)
    (tmp_path / "in" / "Back_Content" / "Batch_1").mkdir(parents=True)
    (tmp_path / "in" / "Back_Content" / "Batch_1" / "b.meca").write_bytes(b"no zip")
    root = str(tmp_path / "in")
    keys = lambda *a: sorted(r.key.rsplit("/", 1)[1] for r in payloads.list_archives(spark, root, *a).collect())
    assert keys() == ["0.meca", "1.meca", "2.meca", "b.meca", "broken.meca"]
    assert keys(dt.date(2025, 6, 15), False) == ["1.meca", "2.meca", "broken.meca"]
    shutil.rmtree(tmp_path / "in" / "Current_Content" / "May_2025")  # a listing from before, of files that are gone
    asked = spark.createDataFrame([("10.1101/2025.06.03.2", 3), ("10.1101/2025.06.03.77", None)], "doi string, version int")
    listed = spark.createDataFrame([(f"Current_Content/May_2025/{i}.meca", f"file:{root}/Current_Content/May_2025/{i}.meca", 5) for i in range(3)], "key string, path string, length bigint").union(payloads.list_archives(spark, root))
    got = payloads.archive_lookup(listed, asked, "b", "biorxiv").collect()
    assert [(r.doi, r.version) for r in got] == [("10.1101/2025.06.03.2", 3)]
    with pytest.raises(Exception, match="(?i)exist"):  # a DOI without a date looks everywhere
        payloads.archive_lookup(listed, spark.createDataFrame([("10.1101/2", 1)], "doi string, version int"), "b", "biorxiv").collect()
    # and doesn't make the dated ones do so
    mixed = spark.createDataFrame([("10.1101/2025.06.03.2", None), ("10.1101/2", None)], "doi string, version int")
    both = payloads.archive_lookup(payloads.list_archives(spark, root), mixed, "b", "biorxiv").collect()
    assert [r.doi for r in both] == ["10.1101/2025.06.03.2"]


def test_what_was_fetched_is_not_fetched_again(spark, tmp_path):
    from lectern.plans.cache import ContentCache

    write_archives(tmp_path / "in", 2)
    root, sizes = str(tmp_path / "in"), 0
    listed = payloads.list_archives(spark, root)
    sizes = sum(r.length for r in listed.collect())
    first = ContentCache(spark, str(tmp_path / "cache"))
    rows = payloads.fetched(first, listed.union(listed), "b").collect()
    assert len(rows) == 6 and all(r.content for r in rows) and first.bytes_downloaded == sizes
    shutil.rmtree(tmp_path / "in")  # nothing is left to fetch from
    second = ContentCache(spark, str(tmp_path / "cache"))
    paths = spark.createDataFrame([(r.key, "gone", 1) for r in rows], "key string, path string, length bigint")
    again = payloads.fetched(second, paths, "b")
    assert {(r.key, bytes(r.content)) for r in again.collect()} == {(r.key, bytes(r.content)) for r in rows} and second.bytes_downloaded == 0
    assert payloads.fetched(second, paths.limit(0), "b").count() == 0


def test_ingest_from_the_command_line_counts_bytes_and_converts(spark, tmp_path, capsys):
    from lectern.cli import main
    from lectern.engine import Engine

    write_archives(tmp_path / "in", 2)
    size = sum(f.stat().st_size for f in (tmp_path / "in").rglob("*.meca"))
    engine = Engine(spark, Settings(cache_dir=str(tmp_path / "cache")))
    run = lambda *a: main([*a], engine)
    reports = []
    for out in ("one", "two"):
        assert run("ingest", str(tmp_path / out), "--root", str(tmp_path / "in")) == 0
        reports.append(json.loads(capsys.readouterr().err.strip().splitlines()[-1]))
    assert [(r["processed"], r["not_found"], r["bytes_downloaded"]) for r in reports] == [(2, 1, size), (2, 1, 0)]
    assert run("convert", str(tmp_path / "one"), str(tmp_path / "pq")) == 0
    assert spark.read.parquet(str(tmp_path / "pq")).count() == reports[0]["n_chunks"] == 8
    assert run("convert", str(tmp_path / "none"), str(tmp_path / "pq2")) == 2 and not (tmp_path / "pq2").exists()


def test_stream_is_the_same_plan(spark, tmp_path):
    from lectern.streaming.ingest import archive_stream, arrivals, ingest_stream

    write_archives(tmp_path / "in")
    load = lambda df: payloads.archive_fulltext(df, "b", "biorxiv").drop("key")
    for n in (5, 6):
        rows = archive_stream(spark, str(tmp_path / "in"), 2).withColumn("target_id", F.col("key"))
        ingest_stream(rows, load, str(tmp_path / "corpus"), str(tmp_path / "cp")).awaitTermination()
        assert read_table(spark, manifest_path(str(tmp_path / "corpus")), MANIFEST).count() == n
        write_archives(tmp_path / "in", 1, 9)
    corpus = read_table(spark, str(tmp_path / "corpus"), CHUNK)
    assert corpus.count() == corpus.select("chunk_id").distinct().count() == 20
    events = spark.createDataFrame([("2025-01-01 00:10:00", "a"), ("2025-01-01 00:50:00", "a"), ("2025-01-01 01:10:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in arrivals(events, "ts", "k").collect()) == [1, 2]


def test_corrupt_lines_are_left_out(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"target_id": "a", "n_chunks": 2}\n\n{"target_id": "b", "n_ch\n{"other": 1}\n')
    rows = read_table(spark, str(tmp_path / "m.json"), MANIFEST, "json")
    assert sorted((r.target_id, r.n_chunks) for r in rows.collect() if r.target_id) == [("a", 2)] and rows.count() == 2
    assert read_table(spark, str(tmp_path / "none"), MANIFEST).count() == 0

"""Command line: version, get, search, discover, ingest."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .functions.dates import parse_since


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lectern").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lectern", description="Full texts of preprints, chunked into corpora.")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("version")
    g = sub.add_parser("get", help="one document as JSON or markdown")
    g.add_argument("id")
    g.add_argument("--version", "-v", type=int)
    g.add_argument("--source", choices=["europepmc", "s3", "html", "arxiv"])
    g.add_argument("--server", choices=["biorxiv", "medrxiv"])
    g.add_argument("--html", action="store_true")
    g.add_argument("--markdown", "-m", action="store_true")
    g.add_argument("--archives", help="folder with the archives")
    g.add_argument("--out", "-o")
    s = sub.add_parser("search", help="hits of a query, as JSON lines")
    s.add_argument("query")
    s.add_argument("--field", default="fulltext")
    s.add_argument("--source", default="europepmc")
    s.add_argument("--limit", "-n", type=int, default=25)
    s.add_argument("--out", "-o")
    d = sub.add_parser("discover", help="hits by topic, category and dates")
    d.add_argument("--query", "-q")
    d.add_argument("--category")
    d.add_argument("--since")
    d.add_argument("--to")
    d.add_argument("--source", default="openalex")
    d.add_argument("--limit", "-n", type=int, default=100)
    d.add_argument("--out", "-o")
    i = sub.add_parser("ingest", help="archives or search results into a corpus")
    i.add_argument("out")
    i.add_argument("--source", default="s3")
    i.add_argument("--root", help="folder with Current_Content/ and Back_Content/")
    i.add_argument("--server", default="biorxiv", choices=["biorxiv", "medrxiv", "both"])
    i.add_argument("--since")
    i.add_argument("--query", "-q", default="*")
    i.add_argument("--include-back-content", action="store_true")
    i.add_argument("--redistribution", action="store_true")
    i.add_argument("--limit", "-n", type=int)
    i.add_argument("--format", default="jsonl", choices=["jsonl", "parquet"])
    i.add_argument("--cache", help="folder of fetched archives, shared by all executors")
    c = sub.add_parser("convert", help="a JSON corpus as Parquet")
    c.add_argument("corpus")
    c.add_argument("out")
    return p


def _emit(text: str, out: str | None) -> None:
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(text)
        print(f"wrote {out}", file=sys.stderr)
    else:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")


def _fail(message: str) -> int:
    print(message, file=sys.stderr)
    return 2


def _ingest(a, engine) -> int:
    from pyspark.sql import functions as F

    from .plans.cache import ContentCache
    from .plans.ingest import ingest
    from .sources import live, payloads

    if a.source == "arxiv":
        return _fail("arXiv's full texts are pages and only fetched one by one: use get, or its own bulk source.")
    if a.source not in ("s3", "europepmc"):
        return _fail(f"unknown source {a.source!r} (s3, europepmc)")
    spark, settings = engine.spark, engine.settings
    if a.source == "s3":
        if not a.root:
            return _fail("--root names the folder with the archives")
        parts = None
        for server in ["biorxiv", "medrxiv"] if a.server == "both" else [a.server]:
            root = f"{a.root}/{server}" if a.server == "both" else a.root
            since = parse_since(a.since)
            listed = payloads.list_archives(spark, root, since, a.include_back_content)
            files = payloads.archive_keys(listed, since, include_back_content=a.include_back_content).withColumn("server", F.lit(server))
            parts = files if parts is None else parts.unionByName(files)
        targets = parts.withColumn("target_id", F.concat_ws(":", "server", "key"))
        targets = targets.orderBy("key").limit(a.limit) if a.limit else targets

        cache = ContentCache(spark, a.cache or settings.cache_dir)
        downloaded = lambda: cache.bytes_downloaded

        def load(df):
            out = None
            for server in ["biorxiv", "medrxiv"] if a.server == "both" else [a.server]:
                bucket = settings.bucket_for(server)
                files = payloads.fetched(cache, df.where(F.col("server") == server).drop("server"), bucket)
                rows = payloads.archive_fulltext(files, bucket, server).drop("key")
                out = rows if out is None else out.unionByName(rows)
            return out
    else:
        items = [*live.epmc_items(engine.fetch, a.query, a.limit or 1000)]
        rows = []
        for doi in dict.fromkeys(i["doi"] for i in items if i.get("doi")):
            ppr = engine._ppr(doi)
            url = f"{live.EPMC}/{ppr}/fullTextXML"
            rows.append((f"doi:{doi}", doi, None, ppr, url, engine._json(url) if ppr else None))
        targets = spark.createDataFrame(rows, "target_id string, doi string, version int, ppr_id string, url string, xml string")
        load, downloaded = payloads.epmc_fulltext, None
    mode = "redistribution" if a.redistribution else "analysis"
    report = ingest(spark, targets, load, a.out, mode, settings, "json" if a.format == "jsonl" else "parquet", lambda m: print(m, file=sys.stderr), downloaded)
    print(json.dumps(report.as_dict()), file=sys.stderr)
    return 0


def main(argv: list[str] | None = None, engine=None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "version":
        print(__version__)
        return 0
    from .engine import Engine, plain
    from .sources.transport import SourceError

    engine = engine or Engine(_session())
    try:
        if a.verb == "get":
            archives = None
            if a.archives:
                from .sources.payloads import list_archives

                archives = list_archives(engine.spark, a.archives)
            row, tried, reason = engine.fulltext(a.id, a.version, a.source, archives, server=a.server, allow_html=a.html)
            if row is None:
                return _fail(f"No full text of {a.id} (tried {', '.join(tried) or 'nothing'}): {reason}")
            _emit(engine.render(row) if a.markdown else json.dumps(plain(row), indent=2, ensure_ascii=False), a.out)
        elif a.verb == "convert":
            from .plans.ingest import to_parquet

            if not to_parquet(engine.spark, a.corpus, a.out):
                return _fail(f"{a.corpus} has no chunks; nothing written")
            print(f"wrote {a.out}", file=sys.stderr)
        elif a.verb in ("search", "discover"):
            hits = engine.search(a.query, a.source, a.field, a.limit) if a.verb == "search" else engine.discover(a.query, a.category, parse_since(a.since), parse_since(a.to), a.source, a.limit)
            rows = hits.limit(a.limit).toJSON().collect()  # at most `limit` rows, for the terminal
            _emit("".join(r + "\n" for r in rows), a.out)
            print(f"{len(rows)} hits", file=sys.stderr)
        else:
            return _ingest(a, engine)
    except SourceError as e:
        return _fail(str(e))
    return 0


if __name__ == "__main__":
    sys.exit(main())

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.functions import dates, ids, licenses, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(f("s").alias("r")).first().r


N, O = "10.64898/2026.06.13.731750", "10.1101/" + "2024.01.15.575000"
SITE = "https://www.{}.org/content/".format
RESOLVER = "doi.org/"
DOIS = {
    N: (N, None),
    f"  {N} ": (N, None),
    "https://" + RESOLVER + N: (N, None),
    "http://dx." + RESOLVER + N + "/": (N, None),
    "https://" + RESOLVER + O + "v3": (O + "v3", 3),
    SITE("biorxiv") + N + "v1.full": (N, 1),
    SITE("biorxiv") + N + "v2": (N, 2),
    SITE("medrxiv") + O + "v1.full-text": (O, 1),
    O + "v12": (O, 12),
    "nothing": ("nothing", None),
    "": ("", None),
    None: ("", None),
}


@pytest.mark.parametrize("raw", DOIS)
def test_dois(spark, raw):
    assert (one(spark, raw, ids.normalize_doi), one(spark, raw, ids.doi_version)) == DOIS[raw]


NEW = "2401.10515"
KNOWN = {
    "arxiv": {NEW: (NEW, None), f"arXiv:{NEW}v2": (NEW, 2), "ar5iv.org/abs/hep-th/9901001": ("hep-th/9901001", None), "math.GT/0309136v1": ("math.GT/0309136", 1), f"10.48550/arXiv.{NEW}": (NEW, None), "10.1101/1234.56789": ("1234.56789", None)},
    "openrxiv": {N: (N, None)},
    "unknown": {"foo/1234567": ("foo/1234567", None), "": ("", None)},
}


@pytest.mark.parametrize(("raw", "kind", "ident", "version"), [(r, k, *x) for k, rows in KNOWN.items() for r, x in rows.items()])
def test_identify(spark, raw, kind, ident, version):
    r = one(spark, raw, ids.identify)
    assert (r.kind, r.id, r.version) == (kind, ident, version)


CC = "creativecommons.org/licenses/"
SPDX = {
    CC + "by/4.0/": "CC-BY-4.0",
    CC + "by-xx/4.0/": None,
    "CC-BY-NC 4.0": "CC-BY-NC-4.0",
    "cc_by_nc_nd": "CC-BY-NC-ND",
    "CC BY or CC BY-NC-ND": "CC-BY-NC-ND",
    "ccby": "CC-BY",
    "CC0": "CC0-1.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 3.0": "CC-BY-NC-SA-3.0",
} | dict.fromkeys(["cc0_ng", "cc_no", None, "", "A government's work"])


@pytest.mark.parametrize(("raw", "spdx"), SPDX.items())
def test_licenses(spark, raw, spdx):
    r = one(spark, raw, licenses.parse_license)
    assert r.spdx_id == spdx and r.redistributable == (spdx is not None) and r.requires_attribution == (spdx != "CC0-1.0")


def test_dates(spark):
    assert one(spark, dt.date(2025, 6, 3), dates.month_folder, "date") == "June_2025"
    assert [one(spark, s, dates.parse_month_folder) for s in ("June_2025", "Juny_2025", "Batch_01", "", "June_2025_x")] == [dt.date(2025, 6, 1), None, None, None, None]
    assert [one(spark, s, dates.doi_posting_date) for s in ("10.1101/2025.06.03.1", "10.1101/2025.13.03.1", "10.1101/123")] == [dt.date(2025, 6, 3), None, None]
    assert dates.parse_since("2025-06") == dt.date(2025, 6, 1) and dates.parse_since(None) is None and dates.parse_since("2025-06-09").day == 9


def test_text(spark):
    assert one(spark, " a  b ( c ) , d [ 1 ] ! ", text.norm) == "a b (c), d [1]!"
    assert one(spark, None, text.norm) == "" and one(spark, "a; ;b ", text.author_list) == ["a", "b"] and one(spark, " \t", text.is_blank)
    assert one(spark, "3.1  Methods", text.without_section_number) == "Methods" and one(spark, "A Study", text.without_section_number) == "Study"
    kinds = {("results", "Background results"): "intro", ("", "Materials"): "methods", (None, "Other"): "other", (None, None): "other"}
    for (kind, title), want in kinds.items():
        df = spark.createDataFrame([(kind, title)], "a string, b string")
        assert df.select(text.kind_of("a", "b").alias("r")).first().r == want
    df = spark.createDataFrame([("x",)], "t string").select(text.kind_of(F.lit(None).cast("string"), "t", F.lit("methods")).alias("r"))
    assert df.first().r == "methods"

"""Payloads of our own making in the formats of each source, put together from elements."""

import io
import zipfile


def el(name: str, *inner: str, **attrs: str) -> str:
    """An element; an attribute's underscores stand for hyphens, a leading X for the link prefix."""
    shown = "".join(f' {("xlink:" + k[1:]) if k[0] == "X" else k.strip("_").replace("_", "-")}="{v}"' for k, v in attrs.items())
    return f"<{name}{shown}>{''.join(inner)}</{name}>"


def _person(role: str, surname: str, given: str = "") -> str:
    return el("contrib", el("name", el("surname", surname), el("given-names", given) if given else ""), contrib_type=role)


_FRONT = el(
    "article-meta",
    el("article-id", "10.1101/2025.06.03.111", pub_id_type="doi"),
    el("title-group", el("article-title", "On ", el("italic", "things"), " , briefly")),
    el("contrib-group", _person("author", "Alder", "Bo"), _person("editor", "Nobody")),
    el("permissions", el("license", el("license-p", "Open"), Xhref="http://creativecommons.org/" + "licenses/by/4.0/")),
    el("abstract", el("p", "GONE"), abstract_type="graphical"),
    el("abstract", el("p", "We did it [", el("xref", "1"), "].")),
)
_BODY = el(
    "body",
    el("sec", el("title", "Start"), el("p", "A ", el("i", "b"), " c ", el("xref", "GONE"), " d."), el("sec", el("p", "Nested inherits.")), sec_type="intro"),
    el("sec", el("title", "Materials &amp; such"), el("p", "How."), el("table-wrap", el("table", el("tr", el("td", "CELL")))), el("fig", el("caption", el("p", "GONE")))),
)
JATS = f'<?xml version="1.0"?>\n<article xmlns:xlink="urn:link">{el("front", el("journal-meta", el("journal-id", "medRxiv")), _FRONT)}{_BODY}{el("back", el("ref-list", el("ref", "GONE")))}</article>'

_INNER = '<section class="ltx_subsection">' + el("h3", "1.1 Detail", class_="ltx_title") + '<p class="ltx_p">Deep.<p class="ltx_p">Deeper.' + "</section>"
LATEXML = el(
    "html",
    el("h1", "A   Title", class_="ltx_title ltx_title_document"),
    el("span", "Cy Dee", class_="ltx_personname"),
    el("div", el("p", "Short ", el("math", "x"), "tale.", class_="ltx_p"), class_="ltx_abstract"),
    el("section", el("h2", el("span", "1 ", class_="ltx_tag ltx_tag_section"), "Introduction", class_="ltx_title"), el("div", el("p", "One ", el("cite", "[GONE]"), "two.", class_="ltx_p")), _INNER, class_="ltx_section"),
    el("section", el("p", "GONE", class_="ltx_p"), class_="ltx_section ltx_bibliography"),
)


def _meta(name: str, content: str) -> str:
    return f'<meta content="{content}" name="citation_{name}">'


_VIEW = el(
    "div",
    el("div", el("h2", "Abstract"), el("p", "Own abstract."), class_="section abstract"),
    el(
        "div",
        el("h2", "Results"),
        el("div", el("p", "Found ", el("a", "1", href="#r1"), ", it."), class_="section-content"),
        el("div", el("h3", "More"), el("p", "And more."), class_="subsection"),
        class_="section",
    ),
    el("div", el("p", "GONE"), class_="fig"),
    el("div", el("h2", "References"), el("p", "GONE"), class_="section ref-list"),
    class_="article fulltext-view",
)
_METAS = [("title", "Page title"), ("doi", "10.1101/9"), ("author", "E. Eff"), ("author", " "), ("abstract", "Meta abstract")]
JOURNAL = el("html", el("head", *[_meta(*m) for m in _METAS]), el("body", _VIEW))

_ENTRIES = [
    el("entry", el("id", "http://arxiv.org/abs/2401.10515v2"), el("title", "A\n  wide title"), el("summary", " Some\ntext "), el("published", "2024-01-19T10:00:00Z"), el("author", el("name", "Gi")), el("author", el("name", " ")), '<x:primary_category term="cs.CL"/>', el("x:doi", "10.9/j")),
    el("entry", el("id", "http://arxiv.org/abs/hep-th/9901001"), el("published", "bad")),
]
FEED = f'<feed xmlns="urn:feed" xmlns:x="urn:x">{"".join(_ENTRIES)}</feed>'


def archive(xml: bytes, name: str = "content/a.xml", manifest: bool = True, **extra: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if manifest:
            items = "".join(f'<instance x:href="{n}"/>' for n in ("content/a.pdf", name))
            z.writestr("manifest.xml", f'<manifest xmlns:x="urn:link">{el("item", items)}</manifest>')
        z.writestr(name, xml)
        for k, v in extra.items():
            z.writestr(f"content/{k}.xml", v)
    return out.getvalue()

"""Parsers of article payloads into one record: JATS XML, LaTeXML pages, journal pages, and zipped archives.

A record has title, doi, authors, abstract, license_raw {href, text} and sections {order, kind, title,
text}. No parser raises on malformed input. Text that follows a removed element stays where it was.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib

from ..functions.text import KIND_RULES
from .tree import Node, parse_html, parse_xml

_DROPPED = frozenset("xref fig fig-group disp-formula inline-formula graphic media supplementary-material label".split())
_TABLES = frozenset("table-wrap table-wrap-group table array".split())
_PROSE = frozenset("p list disp-quote statement boxed-text".split())
_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
_NEEDLES = [(needle, kind) for kind, needles in KIND_RULES.items() for needle in needles]
_NUMBERED = re.compile(r"\s*(?:[A-Z]|\d+)(?:[.]\d+)*\s+")


def norm(text: str | None) -> str:
    s = " ".join((text or "").split())
    return re.sub(r"([\[(])\s+", r"\1", re.sub(r"\s+([\]),.:;!?])", r"\1", s))


def kind_of(own_type: str | None, heading: str | None, above: str | None) -> str:
    """The kind of a section by the same rules as functions.text.kind_of."""
    both = " ".join((own_type or "", heading or "")).lower()
    return next((kind for needle, kind in _NEEDLES if needle in both), above or "other")


def empty_article() -> dict:
    return {"title": None, "doi": None, "authors": [], "abstract": None, "license_raw": None, "sections": []}


def _joined(parts: list[str]) -> str:
    return norm(" ".join(filter(None, parts)))


def _add(sections: list[dict], kind: str, title: str | None, text: str) -> None:
    if text or title:
        sections.append({"order": len(sections) + 1, "kind": kind, "title": title, "text": text})


def parse_jats(xml: bytes | str | None, keep_tables: bool = False) -> dict:
    """JATS: front matter and the body's sections, nested ones after their parents, in document order."""
    art = empty_article()
    root = parse_xml(xml)
    if root is None:
        return art
    gone = _DROPPED if keep_tables else _DROPPED | _TABLES
    clean = lambda n: norm(n.without(lambda c: c.tag in gone).text())
    meta = root.first("article-meta")
    if meta is not None:
        title = meta.find("title-group", "article-title")
        art["title"] = norm(title.text()) if title is not None else None
        doi = next((n for n in meta.nodes() if n.tag == "article-id" and n.get("pub-id-type") == "doi"), None)
        art["doi"] = (doi.text().strip() or None) if doi is not None else None
        for contrib in meta.walk():
            if contrib.tag == "contrib" and contrib.get("contrib-type") == "author":
                for name in (n for n in contrib.nodes() if n.tag == "name"):
                    parts = [p.text() for p in (name.find("given-names"), name.find("surname")) if p is not None]
                    if full := norm(" ".join(p for p in parts if p)):
                        art["authors"].append(full)
        plain = next((n for n in meta.nodes() if n.tag == "abstract" and not n.get("abstract-type")), None)
        art["abstract"] = clean(plain) if plain is not None else None
        licence = meta.find("permissions", "license")
        if licence is not None:
            art["license_raw"] = {"href": licence.get("href"), "text": norm(licence.text()) or None}
    body = root.first("body")
    if body is not None:
        todo: list[tuple[Node, str | None]] = [(n, None) for n in reversed([*body.nodes()]) if n.tag == "sec"]
        while todo:
            sec, above = todo.pop()
            head = sec.find("title")
            heading = norm(head.text()) if head is not None else None
            kind = kind_of(sec.get("sec-type"), heading, above)
            prose = [clean(n) for n in sec.nodes() if n.tag in _PROSE or keep_tables and n.tag == "table-wrap"]
            _add(art["sections"], kind, heading, _joined(prose))
            todo += [(n, kind) for n in reversed([*sec.nodes()]) if n.tag == "sec"]
    return art


def _has(*needles: str):
    return lambda n: any(x in n.classes for x in needles)


_LTX_JUNK = _has("ltx_figure", "ltx_table", "ltx_tabular", "ltx_Math", "ltx_equation", "ltx_bibliography", "ltx_tag_section", "ltx_tag_subsection")


def _paragraphs(sec: Node, nested, is_prose) -> str:
    """Prose of a section, not of what is nested in it."""
    out, stack = [], [*reversed([*sec.nodes()])]
    while stack:
        n = stack.pop()
        if nested(n):
            continue
        if is_prose(n):
            out.append(norm(n.text()))
        else:
            stack += reversed([*n.nodes()])
    return _joined(out)


def parse_latexml(page: bytes | str | None) -> dict:
    """A LaTeXML page; headings lose their number, bibliographies are left out."""
    art = empty_article()
    root = parse_html(page)
    if root is None:
        return art
    title = root.first(lambda n: n.tag == "h1" and "ltx_title_document" in n.classes)
    art["title"] = norm(title.text()) if title is not None else None
    names = [norm(n.text()) for n in root.walk() if "ltx_personname" in n.classes]
    art["authors"] = [n for n in names if n][:200]
    root = root.without(lambda n: n.tag in ("math", "cite") or _LTX_JUNK(n))
    box = root.first(_has("ltx_abstract"))
    if box is not None:
        art["abstract"] = _joined([norm(p.text()) for p in box.walk() if p.tag == "p" and "ltx_p" in p.classes]) or None
    for top in (n for n in root.walk() if n.tag == "section" and "ltx_section" in n.classes):
        todo: list[tuple[Node, str | None]] = [(top, None)]
        while todo:
            sec, inherited = todo.pop()
            if "ltx_bibliography" in sec.classes:
                continue
            head = next((n for n in sec.nodes() if n.tag in _HEADS and "ltx_title" in n.classes), None)
            title = None
            if head is not None:
                text = norm(head.text())
                m = _NUMBERED.match(text)
                title = text[m.end() :] if m else text
            kind = kind_of(None, title, inherited)
            _add(art["sections"], kind, title, _paragraphs(sec, lambda n: n.tag == "section", lambda n: n.tag == "p" and "ltx_p" in n.classes))
            todo += [(n, kind) for n in reversed([*sec.nodes()]) if n.tag == "section"]
    return art


_PAGE_JUNK = _has("fig", "table", "formula", "supplementary", "ref-list")


_APPARATUS = _has(*"copyright fn-group ref-list".split())


def parse_journal_page(page: bytes | str | None) -> dict:
    """A journal's full-text page: citation meta tags, then the sections of the first full-text view."""
    art = empty_article()
    root = parse_html(page)
    if root is None:
        return art
    meta: dict[str, list[str]] = {}
    for n in root.walk():
        if n.tag == "meta" and n.get("name") and n.get("content") is not None:
            meta.setdefault(n.get("name"), []).append(n.get("content").strip())
    one = lambda name: meta.get(name, [None])[0]
    art["title"], art["doi"] = one("citation_title"), one("citation_doi")
    art["authors"] = [a for a in meta.get("citation_author", []) if a]
    view = root.first(lambda n: n.tag == "div" and "fulltext-view" in n.classes)
    if view is None:
        return art
    view = view.without(lambda n: n.tag in ("a", "cite") or _PAGE_JUNK(n))
    inner = lambda n: n.tag == "div" and "section" in n.classes
    todo: list[tuple[Node, str | None]] = [(n, None) for n in reversed([*view.nodes()]) if inner(n)]
    sections: list[dict] = []
    while todo:
        sec, inherited = todo.pop()
        if _APPARATUS(sec):
            continue
        head = next((n for n in sec.nodes() if n.tag in _HEADS[1:5]), None)
        title = norm(head.text()) if head is not None else None
        kind = kind_of(None, title, inherited)
        _add(sections, kind, title, _paragraphs(sec, inner, lambda n: n.tag == "p"))
        todo += [(n, kind) for n in reversed([*sec.nodes()]) if inner(n)]
    own = next((s for s in sections if (s["title"] or "").strip().lower() == "abstract"), None)
    art["abstract"] = own["text"] if own is not None else one("citation_abstract")
    art["sections"] = [s | {"order": k} for k, s in enumerate((s for s in sections if s is not own), start=1)]
    return art


def _is_xml(name: str) -> bool:
    return name.lower().endswith(".xml")


def archive_article(data: bytes | None) -> bytes | None:
    """The article's XML in a zipped archive: what its manifest names, else the largest XML file, of content/ if there."""
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as z:
            names = z.namelist()
            if "manifest.xml" in names and (manifest := parse_xml(z.read("manifest.xml"))) is not None:
                for n in manifest.walk():
                    named = n.get("href") if n.tag.endswith("instance") else None
                    if named in names and _is_xml(named):
                        return z.read(named)
            xml = [n for n in names if _is_xml(n) and n.lower() != "manifest.xml"]
            xml = [n for n in xml if n.startswith("content/")] or xml
            return z.read(max(xml, key=lambda n: z.getinfo(n).file_size)) if xml else None
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
        return None


PARSERS = {"jats": parse_jats, "latexml": parse_latexml, "journal_page": parse_journal_page}

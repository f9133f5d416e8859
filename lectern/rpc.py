"""A JSON-RPC 2.0 server over lines on standard input and output, with four tools of the engine."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from . import __version__

#: Versions of the protocol, the newest first.
PROTOCOLS = sorted("2024-11-05 2025-03-26 2025-06-18".split(), reverse=True)
NAME = "lectern"


class Refused(Exception):
    """A request that gets an error for an answer."""

    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.body = dict(code=code, message=text)


def _content(text: str, is_error: bool) -> dict:
    part = dict(type="text", text=text)
    return {"isError": is_error, "content": [part]}


class Tool:
    def __init__(self, name: str, about: str, run: Callable, required: str, **properties: dict):
        self.name, self.run = name, run
        self.spec = {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": [required]}}


def tools(engine) -> dict[str, Tool]:
    """The tools over an engine; errors that are answers come back as {"error": ...}."""
    from .engine import CATALOGS, plain
    from .operators.search import FIELDS

    text, number = {"type": "string"}, {"type": "integer", "minimum": 1}

    def search(query, limit=25, field="fulltext", source="europepmc"):
        return [json.loads(r) for r in engine.search(query, source, field, limit).limit(limit).toJSON().collect()]

    def fulltext(doi, version=None, as_markdown=False):
        row, tried, reason = engine.fulltext(doi, version)
        if row is None:
            return {"error": reason or "not found", "tried": tried, "doi": doi}
        return engine.render(row) if as_markdown else plain(row)

    def metadata(doi):
        kind, ident, _ = engine.identify(doi)
        row = engine.metadata(ident if kind == "openrxiv" else doi).first()
        return dict(doi=doi, error="not found") if row is None else plain(row)

    made = [
        Tool("search_preprints", "Find preprints by words in a field.", search, "query", query=text, source=text | {"enum": [*CATALOGS]}, field=text | {"enum": [*FIELDS]}, limit=number),
        Tool("get_fulltext", "The sections of one preprint, of its latest version unless another is named.", fulltext, "doi", doi=text, version={"type": "integer"}, as_markdown={"type": "boolean"}),
        Tool("get_metadata", "Bibliographic data of one preprint, with its abstract.", metadata, "doi", doi=text),
        Tool("resolve", "Other identifiers of a DOI or catalog id.", engine.resolve, "doi_or_openalex_id", doi_or_openalex_id=text),
    ]
    made[3].run = lambda doi_or_openalex_id: engine.resolve(doi_or_openalex_id)
    return {t.name: t for t in made}


class Server:
    def __init__(self, tools: dict[str, Tool], name: str = NAME, version: str = __version__):
        self.tools, self.info = tools, {"name": name, "version": version}
        self.methods = {"initialize": self.initialize, "ping": lambda p: {}, "tools/list": lambda p: {"tools": [t.spec for t in tools.values()]}, "tools/call": self.call}

    def initialize(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        return {"serverInfo": self.info, "protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": dict(tools=dict(listChanged=False))}

    @staticmethod
    def wrap(result) -> dict:
        """A tool's result as content; dictionaries with an error are errors."""
        is_text = isinstance(result, str)
        shown = _content(result if is_text else json.dumps(result), isinstance(result, dict) and "error" in result)
        return shown if is_text else shown | {"structuredContent": result if isinstance(result, dict) else dict(result=result)}

    def call(self, params: dict) -> dict:
        tool = self.tools.get(params.get("name"))
        if tool is None:
            raise Refused(-32602, f"Unknown tool: {params.get('name')}")
        given, schema = params.get("arguments") or {}, tool.spec["inputSchema"]
        if set(given) - set(schema["properties"]) or set(schema["required"]) - set(given):
            raise Refused(-32602, f"Invalid arguments for {tool.name}: {sorted(given)}")
        try:
            return self.wrap(tool.run(**given))
        except Exception as e:  # what a tool runs into is its answer
            return _content(repr(e), True)

    def dispatch(self, message: dict) -> dict | None:
        """The response to a message; None to a notification."""
        name, wants_answer = message.get("method") or "", "id" in message
        answer = {"jsonrpc": "2.0"} | {"id": message.get("id")}
        try:
            if name not in self.methods:
                if name.startswith("notifications/") or not wants_answer:
                    return None
                raise Refused(-32601, "Method not found: " + name)
            return answer | {"result": self.methods[name](message.get("params") or {})}
        except Refused as e:
            return answer | {"error": e.body}

    def serve(self, lines=None, out=None) -> None:
        """Answer messages, one a line, until the input ends."""
        out = out or sys.stdout.buffer
        for line in filter(bytes.strip, lines or sys.stdin.buffer):
            try:
                answer = self.dispatch(json.loads(line))
            except json.JSONDecodeError:
                answer = {"jsonrpc": "2.0", "error": Refused(-32700, "Parse error").body, "id": None}
            if answer is not None:
                out.write(json.dumps(answer).encode() + b"\n")
                out.flush()

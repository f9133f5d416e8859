"""Settings: explicit values win over the environment, then a .env file, then a TOML file, then defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from functools import cache
from pathlib import Path

HTTPS = "https://"
PREFIX = "LECTERN_"
#: Names of the environment that are accepted without the prefix as well.
BARE = {"contact_email": "CONTACT_EMAIL", "openalex_api_key": "OPENALEX_API_KEY", "aws_region": "AWS_REGION"}


@dataclass(frozen=True)
class Settings:
    contact_email: str | None = None
    openalex_api_key: str | None = None
    aws_region: str = "us-east-1"
    biorxiv_bucket: str = "biorxiv-src-monthly"
    medrxiv_bucket: str = "medrxiv-src-monthly"
    ar5iv_base: str = HTTPS + "ar5iv.labs.arxiv.org/html"
    cache_dir: str = str(Path.home() / ".cache" / "lectern")
    arxiv_html_base: str = HTTPS + "arxiv.org/html"
    chunk_tokens: int = 512
    arxiv_api_base: str = HTTPS + "export.arxiv.org/api/query"
    chunk_overlap: int = 64
    tokenizer: str = "ws"
    cross_section: bool = False

    def __post_init__(self):
        if self.chunk_tokens < 1 or self.chunk_overlap < 0:
            raise ValueError("chunk_tokens must be at least 1 and chunk_overlap not negative")

    @property
    def user_agent(self) -> str:
        from . import __version__

        return f"lectern/{__version__}" + (f" (mailto:{self.contact_email})" if self.contact_email else "")

    def bucket_for(self, server: str) -> str:
        buckets = {"biorxiv": self.biorxiv_bucket, "medrxiv": self.medrxiv_bucket}
        if server not in buckets:
            raise ValueError(f"no bucket for server {server!r}")
        return buckets[server]


def _dotenv(path: Path) -> dict[str, str]:
    if not path.exists():
        return {}
    pairs = (line.split("=", 1) for line in path.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def load_settings(env: dict[str, str] | None = None, dotenv: str | Path = ".env", toml: str | Path = "lectern.toml", **given) -> Settings:
    """Settings from all layers; unknown keys of the files are ignored."""
    env = dict(os.environ) if env is None else env
    file_env = _dotenv(Path(dotenv))
    table = tomllib.loads(Path(toml).read_text()) if Path(toml).exists() else {}
    values = {}
    for f in fields(Settings):
        names = [PREFIX + f.name.upper(), *([BARE[f.name]] if f.name in BARE else [])]
        found = next((layer[n] for layer in (env, file_env) for n in names if n in layer), table.get(f.name))
        if f.name in given:
            found = given[f.name]
        if found is None:
            continue
        if isinstance(found, str) and f.type in ("int", "bool"):
            found = int(found) if f.type == "int" else found.strip().lower() in ("1", "true", "yes", "on")
        values[f.name] = found
    return Settings(**values)


@cache
def get_settings() -> Settings:
    """The settings of this process, loaded once."""
    return load_settings()

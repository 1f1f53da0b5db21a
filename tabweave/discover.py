"""Finding descriptions and fetching small files.  Driver only."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urljoin
from urllib.request import urlopen

from .model import CONTEXT, TableGroup, is_url


def _get(url: str) -> tuple[bytes, dict[str, str]]:
    with urlopen(url, timeout=30) as r:
        return r.read(), {k.lower(): v for k, v in r.headers.items()}


#: Replaced in tests, and where a cluster has a fetcher of its own: url -> (body, headers).
fetcher: Callable[[str], tuple[bytes, dict[str, str]]] = _get


def fetch(where: str) -> bytes:
    return fetcher(where)[0] if is_url(where) else Path(where).read_bytes()


def _try_json(where: str) -> dict | None:
    try:
        found = json.loads(fetch(where).decode("utf-8-sig"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def locate(url: str) -> tuple[dict, str]:
    """The description of a delimited file, and where it lies: from the Link header, the
    site's well-known file, the two default names, or empty (the header row describes)."""
    if is_url(url):
        try:
            headers = fetcher(url)[1]
        except OSError:
            headers = {}
        for link in re.finditer(r'<([^>]+)>\s*;[^,]*rel="?describedby"?', headers.get("link", "")):
            where = urljoin(url, link[1])
            if found := _try_json(where):
                if any(urljoin(where, t.get("url", "")) == url for t in found.get("tables", [found])):
                    return found, where
                warnings.warn(f"{where} does not describe {url}", stacklevel=2)
        patterns = ["{+url}-metadata.json", "csv-metadata.json"]
        try:
            patterns = fetch(urljoin(url, "/.well-known/csvm")).decode().split() or patterns
        except OSError:
            pass
        candidates = [urljoin(url, p.replace("{+url}", url).replace("{url}", url)) for p in patterns]
    else:
        candidates = [f"{url}-metadata.json", str(Path(url).parent / "csv-metadata.json")]
    for where in candidates:
        if found := _try_json(where):
            if any(str(t.get("url", "")).split("/")[-1] == url.split("/")[-1] for t in found.get("tables", [found])):
                return found, where
    return {"@context": CONTEXT, "url": url.split("/")[-1]}, url


def open_dataset(url: str, metadata: str | None = None) -> TableGroup:
    """The tables of a description, of a delimited file with one, or of a bare file."""
    if metadata:
        return TableGroup.of(json.loads(fetch(metadata).decode("utf-8-sig")), metadata)
    if (found := _try_json(url)) is not None:
        if "@context" not in found:
            raise ValueError(f"{url} has no @context")
        return TableGroup.of(found, url)
    return TableGroup.of(*locate(url))

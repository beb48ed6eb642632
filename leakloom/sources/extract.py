"""Texts inside archives and documents: bytes to (member, text) pairs, with limits."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

ZIPS = ("zip", "jar", "war", "ear", "apk", "ipa", "xpi", "crx")
TARS = ("tar", "tar.gz", "tgz")


@dataclass
class Limits:
    most: int = 10 << 20
    most_in_all: int = 100 << 20
    depth: int = 5
    rows: int = 1000


def extension(name: str) -> str:
    lower = name.lower()
    return "tar.gz" if lower.endswith(".tar.gz") else lower.rpartition(".")[2] if "." in lower.rpartition("/")[2] else ""


def xml_text(raw: bytes) -> str:
    """The text nodes of an XML document, white space collapsed, joined by one space."""
    parts = []
    for node in ElementTree.fromstring(raw).itertext():
        clean = "".join(c for c in " ".join(node.split()) if c.isprintable())
        if clean:
            parts.append(clean)
    return " ".join(parts)


def rtf_text(raw: bytes) -> str:
    """Without control words, braces and what cannot be printed."""
    plain = re.sub(r"\\[^ \r\n]*[ \r\n]?|[{}]", "", raw.decode("latin-1"))
    return "".join(c for c in plain if c.isprintable() or c in "\n\t ")


def _zip_xml(raw: bytes, wanted: str) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(z.namelist()):
            if re.fullmatch(wanted, name):
                text = xml_text(z.read(name))
                if text.strip():
                    yield name, text.encode()


def _notebook(raw: bytes) -> Iterator[tuple[str, bytes]]:
    for i, cell in enumerate(json.loads(raw).get("cells", [])):
        source = cell.get("source")
        if cell.get("cell_type") in ("code", "markdown") and isinstance(source, list) and "".join(source).strip():
            yield f"cell_{i}_{cell['cell_type']}", "".join(source).encode()


def _tables(raw: bytes, rows: int) -> Iterator[tuple[str, bytes]]:
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        f.write(raw)
        f.flush()
        lines = []
        with closing(sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)) as db:
            for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                quoted = name.replace('"', '""')
                for row in db.execute(f'SELECT * FROM "{quoted}"' + (f" LIMIT {int(rows)}" if rows else "")):
                    texts = [v for v in row if isinstance(v, str)]
                    if texts:
                        lines.append(" ".join(texts))
        if lines:
            yield "tables", ("\n".join(lines) + "\n").encode()


def _entries(raw: bytes, kind: str, limits: Limits) -> Iterator[tuple[str, bytes]]:
    if kind in ZIPS:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                if not info.is_dir() and info.file_size <= limits.most:
                    yield info.filename, z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for info in t:
                if info.isfile() and info.size <= limits.most:
                    yield info.name, t.extractfile(info).read()


def members(name: str, raw: bytes, limits: Limits | None = None, depth: int = 0) -> Iterator[tuple[str, bytes]]:
    """The text members of an archive or document; what cannot be read gives none of the rest.

    PDF and 7z need libraries that are not at hand and give nothing.
    """
    limits = limits or Limits()
    if depth > limits.depth:
        return
    kind = extension(name)
    try:
        if kind == "xlsx":
            yield from _zip_xml(raw, r"xl/sharedStrings\.xml|xl/worksheets/sheet[^/]*\.xml")
        elif kind == "docx":
            yield from _zip_xml(raw, r"word/document\.xml")
        elif kind == "pptx":
            yield from _zip_xml(raw, r"ppt/slides/slide[^/]*\.xml")
        elif kind in ("odt", "ods", "odp"):
            yield from _zip_xml(raw, r"content\.xml")
        elif kind == "ipynb":
            yield from _notebook(raw)
        elif kind in ("sqlite", "sqlite3", "db"):
            yield from _tables(raw, limits.rows)
        elif kind == "eml":
            yield "email", raw
        elif kind == "rtf":
            if rtf_text(raw).strip():
                yield "content", rtf_text(raw).encode()
        elif kind in ZIPS or kind in TARS:
            total = 0
            for inner, content in _entries(raw, kind, limits):
                if total + len(content) > limits.most_in_all:
                    return
                total += len(content)
                if b"\x00" not in content[:8192]:
                    yield inner, content
                else:
                    yield from ((f"{inner}:{n}", c) for n, c in members(inner, content, limits, depth + 1))
    except (zipfile.BadZipFile, tarfile.TarError, ElementTree.ParseError, sqlite3.Error, ValueError, KeyError, OSError, EOFError):
        return


# Attributes of elements that may hold secrets.
DATA_ATTRIBUTES = ("data-api-key", "data-token", "data-secret", "data-config")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, str]] = []
        self.counts = {"script": 0, "style": 0, "meta": 0, "data": 0}
        self.inside, self.text = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.inside, self.text = ("" if tag == "script" and "src" in a else tag), []
        if tag == "script" and a.get("src"):
            self.items.append((f"script:external:{a['src']}", ""))
        if tag == "link" and a.get("rel") == "stylesheet" and a.get("href"):
            self.items.append((f"style:external:{a['href']}", ""))
        if tag == "meta" and ("name" in a or "property" in a):
            if len(a.get("content") or "") > 10:
                self.items.append((f"meta:{a.get('name') or a.get('property')}:{self.counts['meta']}", a["content"]))
            self.counts["meta"] += 1
        if any(x in a for x in DATA_ATTRIBUTES):
            self.items += [(f"attr:{x}:{self.counts['data']}", a[x]) for x in DATA_ATTRIBUTES if a.get(x)]
            self.counts["data"] += 1

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.inside:
            content = "".join(self.text).strip()
            if content:
                self.items.append((f"{tag}:inline:{self.counts[tag]}", content))
            self.counts[tag] += 1
            self.inside = ""


def page_items(html: str | None) -> list[tuple[str, str]]:
    """(source, content) parts of a web page: scripts, styles, attributes, meta tags and the whole page.

    External scripts and styles are named, without content, for a fetcher to fill.
    """
    if not html:
        return []
    page = _Page()
    page.feed(html)
    page.close()
    return [*page.items, ("html:full", html)]

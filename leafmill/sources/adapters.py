"""File formats to markdown, with the standard library, in Arrow batches.

PDF and image extraction need models that are not here: they stay behind `register`, as functions
from bytes to markdown. The first registered converter that succeeds wins.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.functions import text as T

DASH_TABLE = str.maketrans(T.DASHES, "-" * len(T.DASHES))
Convert = Callable[[bytes], str]
CONVERTERS: dict[str, list[tuple[str, Convert]]] = {}


def register(ext: str, name: str, convert: Convert) -> None:
    CONVERTERS.setdefault(ext, []).append((name, convert))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, links and emphasis as markdown; scripts and styles left out."""

    BLOCKS = {"p", "div", "article", "section", "footer", "nav", "header", "ul", "ol", "table", "tr", "blockquote"}
    EMPHASIS = {"b": "**", "strong": "**", "i": "_", "em": "_"}

    def __init__(self, describe: Callable[[str], str]) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[str | None] = []
        self.describe = describe

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n  * ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            if self.links[-1]:
                self.out.append("[")
        elif tag == "img" and (src := dict(attrs).get("src")):
            try:
                said = self.describe(src) or "image"
            except Exception:  # a caption is never worth a document
                said = "image"
            self.out.append(f"[Image: {said}]")
        elif tag in self.EMPHASIS:
            self.out.append(self.EMPHASIS[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag == "a" and self.links:
            if href := self.links.pop():
                self.out.append(f"]({href})")
        elif tag in self.EMPHASIS:
            self.out.append(self.EMPHASIS[tag])

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(content: bytes, describe: Callable[[str], str] = lambda src: "image") -> str:
    parser = _Markdown(describe)
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    lines = [line.rstrip() for line in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.startswith("  *") else x.strip() for x in lines)).strip().translate(DASH_TABLE)


def _value(e: ElementTree.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if _local(k) == name), "")


def _related(z: zipfile.ZipFile, folder: str, part: str) -> dict[str, str]:
    """Relationship id to file, for a part of a package."""
    name = f"{folder}/_rels/{part}.rels"
    if name not in z.namelist():
        return {}
    return {e.attrib["Id"]: posixpath.normpath(posixpath.join("/" + folder, e.attrib["Target"])).lstrip("/") for e in ElementTree.fromstring(z.read(name))}


def docx_to_markdown(content: bytes) -> str:
    """Paragraphs of the body, outside tables; a heading is known by the name of its style, whatever
    language its id is in."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else []
    names = {_value(e, "styleId"): next((_value(n, "val") for n in e if _local(n.tag) == "name"), "") for e in styles if _local(e.tag) == "style"}
    body = next((e for e in root if _local(e.tag) == "body"), root)
    lines = []
    for p in (e for e in body if _local(e.tag) == "p"):
        style = next((_value(e, "val") for e in p.iter() if _local(e.tag) == "pStyle"), "")
        text = "".join(e.text or "" for e in p.iter() if _local(e.tag) == "t").strip()
        m = re.match(r"heading\s?([1-6])", names.get(style) or style, re.IGNORECASE)
        lines.append(f"{'#' * int(m[1])} {text}" if m and text else text)
    return "\n".join(lines).translate(DASH_TABLE)


def pptx_to_markdown(content: bytes) -> str:
    """Slides in the order of the presentation, not of their files."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        if "ppt/presentation.xml" in z.namelist() and (rels := _related(z, "ppt", "presentation.xml")):
            listed = [e for e in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _local(e.tag) == "sldId"]
            names = [rels[r] for e in listed if (r := next((v for k, v in e.attrib.items() if k.endswith("}id")), "")) in rels] or names
        slides = [ElementTree.fromstring(z.read(n)) for n in names]
    out = []
    for k, slide in enumerate(slides, 1):
        title, body = "", []
        for shape in (e for e in slide.iter() if _local(e.tag) == "sp"):
            kind = next((e.attrib.get("type", "") for e in shape.iter() if _local(e.tag) == "ph"), "")
            texts = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip() for p in shape.iter() if _local(p.tag) == "p"]
            if kind in ("title", "ctrTitle"):
                title = " ".join(t for t in texts if t)
            else:
                body += [t for t in texts if t]
        out += [f"# {title or f'Slide {k}'}", *body, ""]
    return "\n".join(out).translate(DASH_TABLE)


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """Worksheets as rows of computed values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [e for e in book.iter() if _local(e.tag) == "sheet"]
        titles = [e.attrib.get("name", "") for e in sheets]
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        rels = _related(z, "xl", "workbook.xml")
        of = [rels.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), "")) for e in sheets]
        if all(f in names for f in of):
            files = of
        roots = [ElementTree.fromstring(z.read(n)) for n in files]
    out = []
    for title, root in zip(titles, roots, strict=False):
        rows = []
        for r in (e for e in root.iter() if _local(e.tag) == "row"):
            row: list[str] = []
            for c in (e for e in r if _local(e.tag) == "c"):
                ref = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                at = len(row)
                if ref:
                    at = 0
                    for letter in ref[0]:
                        at = at * 26 + ord(letter) - 64
                    at -= 1
                value = "".join(e.text or "" for e in c.iter() if _local(e.tag) in ("v", "t"))
                if c.attrib.get("t") == "s" and value:
                    value = shared[int(value)]
                row += [""] * (at - len(row)) + [value]
            rows.append(row)
        out.append((title, rows))
    return out


def sheet_lines(title: str, rows: list[list[str]]) -> list[str]:
    """A pipe table: blank rows dropped, rows padded to one width, pipes escaped."""
    full = [[c.replace("|", "\\|").replace("\n", " ").strip() for c in r] for r in rows if any(c.strip() for c in r)]
    if not full:
        return []
    width = max(map(len, full))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in full]
    return [f"## {title}", "", lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:], ""]


def sheet_markdown(title: Column, rows: Column) -> Column:
    """The pipe table of a sheet in a plan: rows of cells under a title."""

    @F.pandas_udf(StringType())  # type: ignore[call-overload]
    def run(titles: pd.Series, sheets: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(sheet_lines(t, [list(r) for r in x])) for t, x in zip(titles, sheets, strict=True)])

    return run(title, rows)


def xlsx_to_markdown(content: bytes) -> str:
    lines = [x for title, rows in xlsx_sheets(content) for x in sheet_lines(title, rows)]
    if not lines:
        raise ValueError("the workbook is empty")
    return "\n".join(lines).translate(DASH_TABLE)


def text_to_markdown(content: bytes) -> str:
    return content.decode("utf-8", "replace")


for _ext, _convert in {
    ".html": html_to_markdown, ".docx": docx_to_markdown, ".pptx": pptx_to_markdown, ".xlsx": xlsx_to_markdown,
    ".md": text_to_markdown, ".markdown": text_to_markdown, ".txt": text_to_markdown,
}.items():
    register(_ext, _ext[1:], _convert)


def convert(content: bytes, ext: str, chain: list[tuple[str, Convert]] | None = None) -> tuple[str | None, str | None, str | None]:
    """(markdown, converter, error): the first converter of the chain whose result isn't blank."""
    errors = []
    for name, f in CONVERTERS.get(ext, []) if chain is None else chain:
        try:
            if (md := f(content)).strip():
                return md, name, None
            errors.append(f"{name}: empty output")
        except Exception as e:  # what one converter can't read the next one may
            errors.append(f"{name}: {e}")
    return None, None, "; ".join(errors)[:2000] or f"no converter for {ext}"


def to_markdown(files: DataFrame) -> DataFrame:
    """files: filename, ext, content, ... Adds md, converter, convert_error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [convert(bytes(c), e) for c, e in zip(b["content"], b["ext"], strict=True)]
            yield b.assign(md=[g[0] for g in got], converter=[g[1] for g in got], convert_error=[g[2] for g in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{schema}, md string, converter string, convert_error string")


def page_markdown(html: Column) -> Column:
    """HTML text to markdown in a plan."""

    @F.pandas_udf(StringType())  # type: ignore[call-overload]
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else html_to_markdown(t.encode()))

    return run(html)


def choose_source(post: Column, raw: Column) -> Column:
    """The cleaned text, unless it has no structure while the raw one has more headings and recovers."""
    from leafmill.operators.levels import heading_count, recoverable

    better = ~recoverable(post) & (heading_count(raw) >= 3) & (heading_count(raw) > heading_count(post)) & recoverable(raw)
    return F.when(better, raw).otherwise(post)


def caption_images(html: Column, captions: Column) -> Column:
    """The i-th image becomes the i-th caption, or 'image'."""
    parts = F.split(html, "(?is)<img\\b[^>]*\\bsrc\\b[^>]*>", -1)
    said = lambda i: F.coalesce(F.get(captions, i), F.lit("image"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("[Image: "), said(i - 1), F.lit("]"), p))), "")

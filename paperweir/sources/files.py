"""Files as documents: discovery, and readers for text, Markdown, HTML, e-mail and Office files."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions.arrow import parts
from paperweir.sources.styles import hiding, rules_of, style_of

# Extensions by format; files that are never documents; HTML tags that break lines, and that hold no text.
FORMATS = {".txt": "text", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".eml": "email", ".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx", ".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image", ".bmp": "image"}
IGNORED = [".DS_Store", "Thumbs.db", "desktop.ini"]
BLOCKS = set("address article aside blockquote br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table title tr ul".split())
SILENT = {"script", "style", "template", "noscript"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
#: Bytes of an archive part that are read at most.
PART_LIMIT = 50 << 20


def discover(spark: SparkSession, root: str, recurse: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): (path, ext, format, length, sha256) in path order, and (path, reason)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    base = raw.where(~name.isin(IGNORED)).where(~F.rlike(F.replace("path", F.lit(root), F.lit("")), F.lit("/\\.[^/]+")))
    ext = F.lower(F.concat(F.lit("."), F.element_at(F.split(name, "\\."), -1)))
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    rows = base.withColumns({"ext": F.when(F.contains(name, F.lit(".")), ext).otherwise(""), "format": F.try_element_at(known, ext)})
    files = rows.where("length > 0 and format is not null").select("path", "ext", "format", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")
    skipped = rows.where("format is null").select("path", F.lit("unsupported file type").alias("reason"))
    empty = spark.createDataFrame([(p, "file is empty") for p in _empty_files(spark, root, recurse)], "path string, reason string")
    return files, skipped.unionByName(empty)


def _empty_files(spark: SparkSession, root: str, recurse: bool) -> list[str]:
    """Spark's file sources pass over empty files, so the listing is asked for them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, listed = [], path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, recurse)
    while listed.hasNext():
        f = listed.next()
        name = f.getPath().getName()
        if f.getLen() == 0 and name not in IGNORED and not name.startswith("."):
            found.append(f.getPath().toString())
    return sorted(found)


def decode(data: bytes) -> tuple[str, str | None]:
    """Text and a warning: UTF-16 with a mark, UTF-8, else Windows-1252. A NUL in the first 4,096 bytes is no text."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace"), None
    if b"\0" in data[:4096]:
        raise ValueError("the file is not text")
    try:
        return data.decode("utf-8-sig"), None
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace"), "decoded as Windows-1252"


class _Page(HTMLParser):
    """Collects text, tables, comments and what a reader would not see."""

    def __init__(self, rules):
        super().__init__(convert_charrefs=True)
        self.rules, self.out, self.stack, self.tables, self.open_tables, self.hidden, self.scripts = rules, [], [], [], [], [], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        style = style_of(tag, a, self.rules)
        outer = self.stack[-1][2] if self.stack else False
        shaded = outer or "bgcolor" in a or any(k in style for k in ("background", "background-color", "background-image"))
        why = None if tag in SILENT else hiding(a, style, shaded)
        if tag == "script":
            self.scripts += 1
        if tag in BLOCKS:
            self.out.append("\n")
        if tag in ("td", "th"):
            self.out.append("\t")
        if tag == "table":
            self.open_tables.append({"rows": [], "merged": 0})
        elif tag == "tr" and self.open_tables:
            self.open_tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.open_tables and self.open_tables[-1]["rows"]:
            spans = [min(max(int(a.get(k) or 1), 1), 1000) if (a.get(k) or "1").isdigit() else 1 for k in ("colspan", "rowspan")]
            self.open_tables[-1]["rows"][-1].append((tag, spans[0]))
            self.open_tables[-1]["merged"] += spans[0] * spans[1] - 1
        if tag not in VOID:
            # What a hidden element holds is one run, in the entry that the element opened.
            entry = self.stack[-1][1] if self.stack else None
            if why and entry is None:
                entry = len(self.hidden)
                self.hidden.append((why[1], [], why[0]))
            self.stack.append((tag, entry, shaded))

    def handle_endtag(self, tag):
        if tag in BLOCKS and tag != "br":
            self.out.append("\n")
        if tag == "table" and self.open_tables:
            t = self.open_tables.pop()
            rows = [r for r in t["rows"] if r]
            cols = max((sum(s for _, s in r) for r in rows), default=0)
            if len(rows) >= 2 and cols >= 2:
                depth = 0
                while depth < len(rows) and all(k == "th" for k, _ in rows[depth]):
                    depth += 1
                self.tables.append({"rows": len(rows), "cols": cols, "header_depth": max(depth, 1), "merged_cells": t["merged"]})
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if any(t in SILENT for t, _, _ in self.stack):
            return
        if any(t == "pre" for t, _, _ in self.stack):
            self.out.append(data)
        else:
            self.out.append(re.sub(r"\s+", " ", data))
        if self.stack and self.stack[-1][1] is not None:
            self.hidden[self.stack[-1][1]][1].append(data)

    def handle_comment(self, data):
        # A comment inside a hidden element goes with it; one in a script or style is that element's text.
        if (not self.stack or self.stack[-1][1] is None) and not any(t in SILENT for t, _, _ in self.stack):
            self.hidden.append((["HTML comment"], [data], "confirmed"))


def parse_html(text: str) -> dict:
    """text, tables, runs [(reasons, text, visibility)] that do not show, the same as hidden [(reasons, text)], and the number of
    scripts of an HTML text. Style elements count wherever they stand."""
    p = _Page(rules_of(text))
    p.feed(text)
    p.close()
    lines = (re.sub(r" ?\t ?", "\t", line).strip() for line in "".join(p.out).split("\n"))
    runs = [(r, re.sub(r"\s+", " ", "".join(t)).strip(), kind) for r, t, kind in p.hidden]
    runs = [r for r in runs if sum(c.isalnum() for c in r[1]) >= 4]
    return {"text": "\n".join(x for x in lines if x), "tables": p.tables, "runs": runs, "hidden": [("; ".join(r), t) for r, t, _ in runs], "scripts": p.scripts}


def markdown_tables(text: str) -> list[dict]:
    """Pipe tables: a row, a rule of dashes, and the pipe rows that follow."""
    out, lines, i = [], text.split("\n"), 0
    while i + 1 < len(lines):
        if "|" in lines[i] and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]) and "-" in lines[i + 1]:
            end = i + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            out.append({"rows": end - i - 1, "cols": len(lines[i].strip().strip("|").split("|")), "header_depth": 1, "merged_cells": 0})
            i = end
        else:
            i += 1
    return out


def _part(z: zipfile.ZipFile, name: str):
    info = z.getinfo(name)
    if info.file_size > PART_LIMIT:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(z.read(name))


def read_docx(data: bytes) -> list[str]:
    body = _part(zipfile.ZipFile(io.BytesIO(data)), "word/document.xml").find(f"{_W}body")
    out = []
    for block in body:
        if block.tag == f"{_W}p":
            out.append("".join(t.text or "" for t in block.iter(f"{_W}t")))
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                out.append("\t".join(" ".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.iter(f"{_W}p")) for c in row.iter(f"{_W}tc")))
    return ["\n".join(x for x in out if x.strip())]


def cell_value(c, shared: list[str]) -> str:
    v = c.find(f"{_S}v")
    if c.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    if v is None:
        return ""
    return shared[int(v.text)] if c.get("t") == "s" else v.text or ""


def read_xlsx(data: bytes) -> list[str]:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in _part(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    pages = []
    for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1])):
        rows = []
        for row in _part(z, name).iter(f"{_S}row"):
            cells = []
            for c in row.iter(f"{_S}c"):
                value = cell_value(c, shared)
                if value:
                    cells.append(value)
            if cells:
                rows.append("\t".join(cells))
        pages.append("\n".join(rows))
    return pages


def slide_order(z: zipfile.ZipFile) -> list[str]:
    """The slides' parts as the presentation lists them, or else by number."""
    names = z.namelist()
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    if "ppt/presentation.xml" in names and "ppt/_rels/presentation.xml.rels" in names:
        target = {r.get("Id"): "ppt/" + r.get("Target").removeprefix("/ppt/") for r in _part(z, "ppt/_rels/presentation.xml.rels")}
        ids = [v for e in _part(z, "ppt/presentation.xml").iter() if e.tag.endswith("}sldId") for k, v in e.attrib.items() if k.endswith("}id")]
        return [target[i] for i in ids if target.get(i) in names] or slides
    return slides


def read_pptx(data: bytes) -> list[str]:
    z = zipfile.ZipFile(io.BytesIO(data))
    names, order = z.namelist(), slide_order(z)
    pages = []
    for name in order:
        root = _part(z, name)
        text = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in root.iter(f"{_A}p")]
        notes = name.replace("slides/slide", "notesSlides/notesSlide")
        if notes in names:
            text += ["", *("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in _part(z, notes).iter(f"{_A}p"))]
        pages.append("\n".join(text).strip())
    return pages


def read_eml(data: bytes) -> tuple[str, list[str]]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    if not m.keys():
        raise ValueError("the file has no header")
    head = [f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if m[k]]
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = parse_html(text)["text"]
    attached = sum(1 for _ in m.iter_attachments())
    warnings = [f"{attached} attachments were not read"] * bool(attached) + [type(d).__name__ for d in m.defects]
    return "\n".join(head) + "\n\n" + text.strip(), warnings


def read_one(kind: str, data: bytes) -> tuple[list[str], list[str]]:
    """(pages, warnings) of a file, or ValueError. A reader in READERS comes before the built-in one of its format."""
    if kind in READERS:
        return READERS[kind](data), []
    if kind in ("text", "markdown", "html"):
        text, warning = decode(data)
        warnings = [warning] if warning else []
        if kind == "html":
            page = parse_html(text)
            text = page["text"]
            if page["scripts"] and sum(c.isalnum() for c in text) < 200:
                warnings.append("the page is built by scripts; little text was found")
        return [text], warnings
    if kind == "email":
        text, warnings = read_eml(data)
        return [text], warnings
    raise ValueError("no reader for this format is installed")


#: Formats with a reader of bytes -> pages; add one for PDF or images where a library for them is there, or one of your own.
READERS = {"docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx}


def read_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, skipped) of binary files (path, content, format). A file that cannot be read is a row of skipped, not an error.

    pages: (document, page, text, text_source, format, warnings)."""
    schema = "document string, page int, text string, text_source string, format string, warnings array<string>, reason string"
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content, kind in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    pages, warnings = read_one(kind, content)
                    rows += [(path, i + 1, t, "native" if t.strip() else "none", kind, warnings, None) for i, t in enumerate(pages)]
                except Exception as e:  # a bad file never stops the run
                    rows.append((path, 0, None, "none", kind, [], f"file could not be read: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[s.split()[0] for s in schema.split(", ")]) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=[s.split()[0] for s in schema.split(", ")])

    out = files.select("path", "content", "format").mapInArrow(run, schema)
    return out.where("reason is null").drop("reason"), out.where("reason is not null").select(F.col("document").alias("path"), "reason")


def hidden_runs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, unchecked) of binary files (path, content, format): (document, page, text, visibility, reason,
    only_if_instruction), as hidden.findings() takes them, and (document, note) of files that were not checked."""
    schema = "document string, page int, text string, visibility string, reason string, only_if_instruction boolean, note string"
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    names = [s.split()[0] for s in schema.split(", ")]

    def run(batches):
        from paperweir.sources.visibility import file_runs

        for batch in batches:
            rows = []
            for path, content, kind in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found, note = file_runs(kind, content)
                rows += [(path, r.page or 1, r.text, r.visibility, "; ".join(r.reasons), r.only_if_instruction, None) for r in found]
                if note:
                    rows.append((path, None, None, None, None, None, note))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    out = files.select("path", "content", "format").mapInArrow(run, schema)
    return out.where("note is null").drop("note"), out.where("note is not null").select("document", "note")


def html_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, tables, hidden) of HTML texts."""
    t = "array<struct<rows:int,cols:int,header_depth:int,merged_cells:int>>"
    schema = f"{key} long, text string, tables {t}, hidden array<struct<reason:string,text:string>>"
    tk = pa.list_(pa.struct([("rows", pa.int32()), ("cols", pa.int32()), ("header_depth", pa.int32()), ("merged_cells", pa.int32())]))
    hk = pa.list_(pa.struct([("reason", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in parts(batches, 1):
            parsed = [parse_html(h or "") for h in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([p["text"] for p in parsed], pa.string()), pa.array([p["tables"] for p in parsed], tk), pa.array([[{"reason": r, "text": x} for r, x in p["hidden"]] for p in parsed], hk)]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "text", "tables", "hidden"])

    return pages.select(F.col(key).cast("long"), html).mapInArrow(run, schema)

"""What a reader of a file would not see: runs of text hidden by styles, markup or formatting, with reasons."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from typing import NamedTuple

from paperweir.sources import files
from paperweir.sources.styles import SMALLEST, is_white

# Letters and digits of the shortest run, characters of a run that are kept.
LETTERS, KEPT = 4, 2000


class Run(NamedTuple):
    page: int | None
    text: str
    visibility: str
    reasons: list[str]
    #: Common in ordinary files, and so of interest only if it reads as an instruction.
    only_if_instruction: bool = False


def run(text: str, reasons: list[str], visibility: str = "confirmed", page: int | None = None, routine: bool = False) -> list[Run]:
    """A run in a list, or none if it has too few letters and digits."""
    text = " ".join(text.split())
    return [Run(page, text[:KEPT], visibility, reasons, routine)] if sum(c.isalnum() for c in text) >= LETTERS else []


def html_runs(markup: str) -> list[Run]:
    page = files.parse_html(markup)
    return [r for reasons, text, kind in page["runs"] for r in run(text, reasons, kind, routine=True)]


def markdown_runs(text: str) -> list[Run]:
    """Comments, link references used as comments, and what inline HTML hides; code is left out."""
    blank = lambda m: " " * len(m[0])
    text = re.sub(r"`[^`\n]+`", blank, re.sub(r"^(```|~~~).*?^\1[ \t]*$", blank, text, flags=re.S | re.M))
    out = []
    for rx, reason in ((r"(?s)<!--(.*?)-->", "HTML comment, not shown when the Markdown is rendered"), (r"""(?m)^[ \t]*\[[^\]]*\]:[ \t]*(?:#|<>)[ \t]*[("'](.*)[)"'][ \t]*$""", "link reference used as a comment, not shown when the Markdown is rendered")):
        for body in re.findall(rx, text):
            out += run(body, [reason], routine=True)
    rest = re.sub(r"(?s)<!--.*?-->", " ", text)
    return out + (html_runs(rest) if re.search(r"<[a-zA-Z][^>]*>", rest) else [])


def eml_runs(data: bytes) -> list[Run]:
    body = email.message_from_bytes(data, policy=email.policy.default).get_body(("html",))
    return html_runs(body.get_content()) if body is not None else []


def _w(node, name: str):
    return node.find(files._W + name) if node is not None else None


def _val(node, name: str = "val") -> str | None:
    return node.get(files._W + name) if node is not None else None


def _look(props) -> dict:
    """What run properties say: hidden, colour, size in points, shaded."""
    out = {}
    if (v := _w(props, "vanish")) is not None:
        out["hidden"] = _val(v) not in ("0", "false", "off")
    if (v := _w(props, "color")) is not None:
        out["color"] = _val(v)
    if (v := _w(props, "sz")) is not None and (_val(v) or "").isdigit():
        out["size"] = int(_val(v)) / 2
    if _w(props, "highlight") is not None or _filled(props):
        out["shaded"] = True
    return out


def _filled(props) -> bool:
    fill = _val(_w(props, "shd"), "fill")
    return fill not in (None, "auto") and not is_white(fill)


def docx_runs(data: bytes) -> list[Run]:
    """Hidden, white and tiny text of Word files, directly or by style; neighbours with the same reasons are one run."""
    z = zipfile.ZipFile(io.BytesIO(data))
    root = files._part(z, "word/document.xml")
    own, base = {}, {}
    if "word/styles.xml" in z.namelist():
        for s in files._part(z, "word/styles.xml").iter(files._W + "style"):
            name = _val(s, "styleId")
            own[name], base[name] = _look(_w(s, "rPr")), _val(_w(s, "basedOn"))

    def styled(name: str | None, depth: int = 0) -> dict:
        return {} if name not in own or depth > 20 else styled(base[name], depth + 1) | own[name]

    page = _w(root, "background")
    coloured = page is not None and not is_white(_val(page, "color"))
    out: list[Run] = []
    for p in root.iter(files._W + "p"):
        props = _w(p, "pPr")
        held: list[tuple[tuple[str, ...], str]] = []
        for r in p.iter(files._W + "r"):
            text = "".join(t.text or "" for t in r.iter(files._W + "t"))
            if not text:
                continue
            mine = _w(r, "rPr")
            look = styled(_val(_w(props, "pStyle"))) | styled(_val(_w(mine, "rStyle"))) | _look(mine)
            behind = coloured or _filled(props) or look.get("shaded")
            reasons = {"formatted as hidden text": look.get("hidden"), "white text": is_white(look.get("color")) and not behind, f"font size below {SMALLEST:g}pt": look.get("size", SMALLEST) < SMALLEST}
            why = tuple(k for k, v in reasons.items() if v)
            if held and held[-1][0] == why:
                held[-1] = (why, held[-1][1] + text)
            else:
                held.append((why, text))
        out += [r for why, text in held if why for r in run(text, list(why))]
    return out


def _column(cell: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", cell)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_runs(data: bytes) -> list[Run]:
    """Hidden sheets, rows and columns, formats that show nothing, and white text on no fill, of Excel files."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names, tag = z.namelist(), files._S
    shared = ["".join(t.text or "" for t in s.iter(f"{tag}t")) for s in files._part(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    sheets = [(s.get("name"), s.get("state", "visible")) for s in files._part(z, "xl/workbook.xml").iter(f"{tag}sheet")] if "xl/workbook.xml" in names else []
    formats, fonts, fills, cells = {}, [], [], []
    if "xl/styles.xml" in names:
        styles = files._part(z, "xl/styles.xml")
        formats = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{tag}numFmt")}
        fonts = [next((c.get("rgb") for c in f.iter(f"{tag}color")), None) for f in styles.iterfind(f"{tag}fonts/{tag}font")]
        fills = [next((None if p.get("patternType") in (None, "none") else next((c.get("rgb") for c in p.iter(f"{tag}fgColor")), "") for p in f.iter(f"{tag}patternFill")), None) for f in styles.iterfind(f"{tag}fills/{tag}fill")]
        cells = [(x.get("numFmtId"), int(x.get("fontId", 0)), int(x.get("fillId", 0))) for x in styles.iterfind(f"{tag}cellXfs/{tag}xf")]
    out: list[Run] = []
    paths = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    for number, path in enumerate(paths, 1):
        title, state = sheets[number - 1] if number <= len(sheets) else (f"Sheet{number}", "visible")
        root = files._part(z, path)
        gone = {i for c in root.iter(f"{tag}col") if c.get("hidden") in ("1", "true") for i in range(int(c.get("min")), int(c.get("max")) + 1)}
        groups: dict[str, list[str]] = {}
        for row in root.iter(f"{tag}row"):
            for place, c in enumerate(row.iter(f"{tag}c"), 1):
                value = files.cell_value(c, shared)
                if not value.strip():
                    continue
                code, font, fill = cells[int(c.get("s", 0))] if int(c.get("s", 0)) < len(cells) else (None, -1, -1)
                shown = formats.get(code, "")
                white = 0 <= font < len(fonts) and is_white(fonts[font]) and (not 0 <= fill < len(fills) or fills[fill] is None or is_white(fills[fill]))
                why = (
                    f"{'very hidden' if state == 'veryHidden' else 'hidden'} sheet {title!r}" if state != "visible"
                    else f"hidden row in sheet {title!r}" if row.get("hidden") in ("1", "true")
                    else f"hidden column in sheet {title!r}" if (_column(c.get("r")) if c.get("r") else place) in gone
                    else f"number format that displays nothing, in sheet {title!r}" if ";" in shown and not shown.replace(";", "").strip()
                    else f"white text in sheet {title!r}" if white else None
                )
                if why:
                    groups.setdefault(why, []).append(" ".join(value.split()))
        out += [r for why, values in groups.items() for r in run(" | ".join(values), [why], page=number)]
    return out


def pptx_runs(data: bytes) -> list[Run]:
    """Hidden slides, shapes outside the slide, and tiny text, of PowerPoint files."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    width, height = 9144000, 6858000
    if "ppt/presentation.xml" in names:
        for e in files._part(z, "ppt/presentation.xml").iter():
            if e.tag.endswith("}sldSz"):
                width, height = int(e.get("cx")), int(e.get("cy"))
    out: list[Run] = []
    for number, name in enumerate(files.slide_order(z), 1):
        root = files._part(z, name)
        if root.get("show") in ("0", "false"):
            out += run(" ".join(t.text or "" for t in root.iter(f"{files._A}t")), ["hidden slide"], page=number)
            continue
        for shape in (e for e in root.iter() if e.tag.endswith("}sp")):
            off, ext = (next((e for e in shape.iter() if e.tag == files._A + k), None) for k in ("off", "ext"))
            x, y = (int(off.get(k, 0)) for k in "xy") if off is not None else (0, 0)
            cx, cy = (int(ext.get(k, 0)) for k in ("cx", "cy")) if ext is not None else (1, 1)
            sizes = [float(e.get("sz")) for e in shape.iter() if e.tag == f"{files._A}rPr" and e.get("sz")]
            reasons = ["placed outside the slide"] * (off is not None and (x >= width or y >= height or x + cx <= 0 or y + cy <= 0))
            reasons += [f"font size below {SMALLEST:g}pt"] * bool(sizes and max(sizes) < 100 * SMALLEST)
            if reasons:
                out += run(" ".join(t.text or "" for t in shape.iter(f"{files._A}t")), reasons, page=number)
    return out


def file_runs(kind: str, data: bytes) -> tuple[list[Run], str | None]:
    """Hidden runs of a file by its format, and a note where it was not checked. A file that cannot be parsed is not checked."""
    checks = {
        "html": lambda d: html_runs(files.decode(d)[0]), "markdown": lambda d: markdown_runs(files.decode(d)[0]), "email": eml_runs, "docx": docx_runs, "xlsx": xlsx_runs, "pptx": pptx_runs,
        "text": lambda d: [], "image": lambda d: [],
    }
    if kind not in checks:
        return [], f"hidden text is not checked in {kind} files"
    try:
        return checks[kind](data), None
    except Exception as e:  # a file that cannot be parsed is unchecked, which is said; the others go on
        return [], f"the hidden-text check failed ({type(e).__name__}: {e})"

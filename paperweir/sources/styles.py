"""Styles of HTML elements, and whether they hide their text."""

from __future__ import annotations

import re

# Points below which text is too small, brightness of white, points off screen.
SMALLEST, WHITE, OFF_SCREEN = 1.0, 0.94, 500.0


def declarations(style: str | None) -> dict[str, str]:
    pairs = (d.partition(":") for d in re.sub(r"/\*.*?\*/", "", style or "", flags=re.S).split(";"))
    return {k.strip().lower(): v.replace("!important", "").strip().lower() for k, _, v in pairs if v.strip()}


def rules_of(markup: str) -> list[tuple[str, dict[str, str]]]:
    """(simple selector, declarations) of the style elements, in order. Selectors of more than a tag, class or id are left out."""
    out = []
    for css in re.findall(r"<style\b[^>]*>(.*?)</style", markup, re.S | re.I):
        for selectors, body in re.findall(r"([^{}@]+)\{([^{}]*)\}", re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
            own = declarations(body)
            out += [(s.strip(), own) for s in selectors.split(",") if own and re.fullmatch(r"([a-zA-Z][a-zA-Z0-9]*)?([.#][\w-]+)?", s.strip()) and s.strip()]
    return out


def style_of(tag: str, attrs: dict[str, str], rules: list[tuple[str, dict[str, str]]]) -> dict[str, str]:
    names = {tag, *(f".{c}" for c in attrs.get("class", "").split())} | ({f"#{attrs['id']}"} if attrs.get("id") else set())
    out: dict[str, str] = {}
    for selector, own in rules:
        parts = re.fullmatch(r"([^.#]*)(.*)", selector).groups()
        if all(not p or (p.lower() if p[0] not in ".#" else p) in names for p in parts):
            out.update(own)
    return out | declarations(attrs.get("style"))


def points(value: str | None) -> float | None:
    """A length in points; relative ones are known only where they are zero."""
    m = re.fullmatch(r"(-?\d*\.?\d+)\s*(px|pt|em|rem|%)?", (value or "").strip())
    if not m:
        return None
    number, unit = float(m[1]), m[2] or "px"
    return number if unit == "pt" else number * 0.75 if unit == "px" else 0.0 if number == 0 else None


def is_white(value: str | None) -> bool:
    v = (value or "").replace(" ", "").lower()
    if v == "white":
        return True
    if m := re.fullmatch(r"#?([0-9a-f]{2})?([0-9a-f]{6})", v):
        channels = [int(m[2][i : i + 2], 16) for i in (0, 2, 4)]
    elif m := re.fullmatch(r"#([0-9a-f]{3})", v):
        channels = [int(c * 2, 16) for c in m[1]]
    elif m := re.fullmatch(r"rgba?\((\d+),(\d+),(\d+)(?:,[\d.]+)?\)", v):
        channels = [int(c) for c in m.groups()]
    else:
        return False
    return min(channels) >= int(WHITE * 255)


def hiding(attrs: dict[str, str], style: dict[str, str], shaded: bool) -> tuple[str, list[str]] | None:
    """Whether an element does not show, and why, or None."""
    color, size = style.get("color"), points(style.get("font-size"))
    try:
        clear = float(style.get("opacity", "1")) <= 0.01
    except ValueError:
        clear = False
    found = {
        "hidden attribute": "hidden" in attrs, "display: none": style.get("display") == "none", "visibility: hidden": style.get("visibility") in ("hidden", "collapse"), "opacity: 0": clear,
        "transparent text": color == "transparent", "white text": not shaded and is_white(color), f"font size below {SMALLEST:g}pt": size is not None and size < SMALLEST,
        "zero height with overflow hidden": style.get("overflow") == "hidden" and 0.0 in (points(style.get("height")), points(style.get("max-height"))),
    }
    if reasons := [k for k, v in found.items() if v]:
        return "confirmed", reasons
    off = any((p := points(style.get(k))) is not None and p <= -OFF_SCREEN for k in ("left", "top", "text-indent", "margin-left"))
    return ("suspected", ["positioned off screen"]) if off else None

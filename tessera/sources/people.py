"""Fields that markup gives to an address: neighbours, schema.org persons, cards, staff lists; and hidden addresses.

Pages are parsed in Arrow batches as in ``tessera.sources.html``.  Null pages are empty; a page
whose markup can't be read gives no rows here and its error there.
"""

from __future__ import annotations

import base64
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions import patterns as P
from tessera.operators import matcher as M
from tessera.sources import html as H
from tessera.sources.html import Node, has_at, is_email, is_email_strict, parse

# Fixed values.
_PERSON = re.compile(r"schema\.org/(Person|Employee)")
_PROPERTIES = {"name": "name", "title": "jobTitle", "phone": "telephone", "company": "worksFor"}
_CARDS = ("vcard", "hcard", "contact-card", "person-card", "staff-member", "team-member", "employee-card")
_CARD_PARTS = {"name": re.compile("fn|name", re.I), "title": re.compile("title|role|position", re.I), "company": re.compile("org|company|organization", re.I)}
_SECTION = re.compile("contact|team|staff|about", re.I)
_STAFF_CLASS, _STAFF_ID = re.compile("staff|faculty|academic|directory|team|people", re.I), re.compile("staff|faculty|team|people", re.I)
_STAFF_EMAIL = re.compile(r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})")
_HEADINGS = ("h1", "h2", "h3", "h4", "strong", "b", "span")
_SHAPED_NAME = re.compile(r"^([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?(?:\s+[A-Z][a-z]+){1,2})$")
_NEAR_TITLES = ("Professor", "Prof", "Associate Professor", "Assistant Professor", "Dr", "PhD", "Director", "Dean", "Chair", "Head", "Senior Lecturer", "Lecturer", "Research Fellow", "Researcher")
_ACADEMIC_TITLES = r"Professor\s+Dr\.?|Prof\.?\s+Dr\.?|Associate\s+Professor|Assistant\s+Professor|Dr\.?\s+|PhD\.?|Research\s+Fellow|Lecturer|Senior\s+Lecturer|Director|Dean"
_ACADEMIC_NAME = r"[A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?(?:\s+[A-Z][a-z]+)+"
_HIDING_STYLES = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
_HIDING_CLASSES = ("hidden", "sr-only")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}")
_JOINED = (re.compile(r"'([^']+)'\s*\+\s*'@'\s*\+\s*'([^']+)'"), re.compile(r'"([^"]+)"\s*\+\s*"@"\s*\+\s*"([^"]+)"'))
_ASSIGNED = (re.compile(r"email\s*[:=]\s*[\"']([^\"']+@[^\"']+)[\"']", re.I), re.compile(r"mail\s*[:=]\s*[\"']([^\"']+@[^\"']+)[\"']", re.I))

_FIELDS = ("name", "title", "phone", "company")
_EMAIL = re.compile(P.EMAIL)
_NAMES, _PHONES = [re.compile(p) for p in M.NAMES], [re.compile(p) for p, _ in M.PHONES]
_NAME_FIRST = re.compile(rf"({_ACADEMIC_TITLES})?\s*({_ACADEMIC_NAME})", re.I)
# Reversed: words of a name, then an initial, the first name and the words of a title.
_LEADING = re.compile(r"\s*(?:[a-z]{2,}\s+)*(?:\s*\.?[a-z]+){0,5}\s*", re.I)


def _named(text: str) -> dict[str, str]:
    """The first name and the first phone number of a text."""
    out = {}
    names = (re.sub(r"\s+", " ", m[1]).strip() for p in _NAMES for m in p.finditer(text))
    person = next((n for n in names if 2 <= len(n) <= 100 and sum(map(str.isalpha, n)) >= 0.7 * len(n) and n.lower() not in M.NOT_PERSONS), None)
    if person:
        out["name"] = person
    phone = next((m for p in _PHONES for m in p.finditer(text)), None)
    if phone:
        out["phone"] = "-".join(phone.groups())
    return out


class _Page:
    """A parsed page whose element texts are made once."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.nodes = list(self.root.walk())
        self._texts: dict[tuple, str] = {}
        self._fields: dict[int, dict[str, str]] = {}

    def text(self, x: Node, sep: str = "", strip: bool = False) -> str:
        key = (id(x), sep, strip)
        if key not in self._texts:
            self._texts[key] = x.text(sep, strip)
        return self._texts[key]

    def named(self, x: Node) -> dict[str, str]:
        if id(x) not in self._fields:
            self._fields[id(x)] = _named(self.text(x))
        return self._fields[id(x)]

    def emails(self) -> list[str]:
        """Distinct addresses of the text and of links, lower-cased, in order."""
        places = [self.text(self.root, " "), *(x.attrs.get("href", "") for x in self.nodes if x.tag == "a")]
        return list(dict.fromkeys(e.lower() for t in places if "@" in t for e in _EMAIL.findall(t) if is_email(e.lower())))


def _classed(x: Node, pattern: re.Pattern) -> bool:
    value = x.attrs.get("class", "")
    return any(pattern.search(c) for c in [*value.split(), value])


def _merge(into: dict[str, str], found: dict[str, str]) -> None:
    for k, v in found.items():
        if v:
            into.setdefault(k, v)


def _neighbours(page: _Page, email: str, holders: list[tuple[Node, str]]) -> dict[str, str]:
    """Names and phones of short elements beside the address: its element's parent, that one's descendants, three siblings a side."""
    out: dict[str, str] = {}
    for x, low in holders:
        if email not in low or "name" in out and "phone" in out:
            continue
        before, after = x.siblings()
        for near in [*([x.parent, *x.parent.walk()] if x.parent else []), *after[:3], *before[:3]]:
            text = page.text(near, strip=True)
            if text and len(text) < 200:
                _merge(out, _named(text))
    return out


def _first(box: Node, test) -> Node | None:
    return next((x for x in box.walk() if test(x)), None)


def _schema(page: _Page, email: str, persons: list[Node]) -> dict[str, str]:
    """Properties of schema.org persons that name the address; a later person's win."""
    out = {}
    for box in persons:
        if email in page.text(box).lower():
            for field, prop in _PROPERTIES.items():
                if (x := _first(box, lambda n, prop=prop: n.attrs.get("itemprop") == prop)) is not None:
                    out[field] = page.text(x, strip=True)
    return out


def _card(page: _Page, email: str, cards: list[Node]) -> dict[str, str]:
    """Parts of cards that name the address, by class; a later card's win over earlier ones and over plain text."""
    out: dict[str, str] = {}
    for box in cards:
        if email in page.text(box).lower():
            _merge(out, page.named(box))
            for field, pattern in _CARD_PARTS.items():
                if (x := _first(box, lambda n, pattern=pattern: _classed(n, pattern))) is not None:
                    out[field] = page.text(x, strip=True)
    return out


def _section(page: _Page, email: str, sections: list[Node]) -> dict[str, str]:
    out: dict[str, str] = {}
    for box in sections:
        if email in page.text(box).lower():
            _merge(out, page.named(box))
    return out


def markup_fields(page: _Page) -> list[tuple]:
    """``(email, name, title, phone, company)`` of every address; neighbours first, then persons, cards and sections."""
    holders = [(x, s.lower()) for x in [page.root, *page.nodes] for s in x.children if isinstance(s, str) and "@" in s]
    holders += [(x, x.attrs["href"].lower()) for x in page.nodes if x.tag == "a" and "@" in x.attrs.get("href", "")]
    persons = [x for x in page.nodes if _PERSON.search(x.attrs.get("itemtype", ""))]
    cards = [x for c in _CARDS for x in page.nodes if c in x.attrs.get("class", "").split()]
    sections = [x for x in page.nodes if x.tag in ("div", "section", "article") and _classed(x, _SECTION)]
    out = []
    for email in page.emails():
        found: dict[str, str] = {}
        for part in (_neighbours(page, email, holders), _schema(page, email, persons), _card(page, email, cards), _section(page, email, sections)):
            _merge(found, part)
        out.append((email, *(found.get(f) for f in _FIELDS)))
    return out


def _spans(text: str, user: str) -> list[tuple[int, int]]:
    """Parts of a text that hold every match which ends in ``user``.

    Each begins at the first line from which a title and a name lead up to the
    user's line, and ends with the line's last user; parts that touch are one.
    """
    back, line, out = text[::-1], -1, []
    for m in re.finditer(f"(?={re.escape(user)})", text, re.I):
        start, end = text.rfind("\n", 0, m.start()) + 1, m.start() + len(user)
        if start != line:
            line, lo = start, len(text) - _LEADING.match(back, len(text) - start).end()
            while out and lo <= out[-1][1]:
                lo = min(lo, out.pop()[0])
            out.append((lo, end))
        out[-1] = (out[-1][0], end)
    return out


def academic(text: str, email: str) -> tuple[str, str]:
    """``(title, name)`` before the local part, else behind it, over any number of lines; empty if there is none."""
    user = email.split("@")[0]
    before = re.compile(rf"{_NAME_FIRST.pattern}\s*.*?{re.escape(user)}", re.I)
    behind = re.compile(rf"{re.escape(user)}\s*.*?{_NAME_FIRST.pattern}", re.I)
    m = next((m for lo, hi in _spans(text, user) if (m := before.search(text, lo, hi))), None) or behind.search(text)
    return ((m[1] or "").strip(), m[2].strip()) if m else ("", "")


def title_near(text: str, name: str) -> str:
    """The first of the titles, in their order, within 50 characters of the name."""
    at = text.find(name)
    near = text[max(0, at - 50) : at + len(name) + 50] if at >= 0 else ""
    return next((t for t in _NEAR_TITLES if re.search(rf"\b{t}\b", near, re.I)), "")


def staff(page: _Page) -> list[tuple]:
    """``(email, name, title, context)`` of the entries of staff lists; an entry in two lists comes twice."""
    boxes = [x for x in page.nodes if x.tag in ("div", "table", "ul", "section") and _classed(x, _STAFF_CLASS)]
    boxes += [x for x in page.nodes if x.tag in ("div", "section") and _STAFF_ID.search(x.attrs.get("id", ""))]
    out = []
    for entry in (x for box in boxes for x in box.walk() if x.tag in ("tr", "li", "div", "article")):
        text = page.text(entry, " ", True)
        for email in _STAFF_EMAIL.findall(text) if "@" in text else ():
            user = email.split("@")[0].lower()
            headings = (page.text(x, strip=True) for x in entry.walk() if x.tag in _HEADINGS)
            name = next((n for n in headings if _SHAPED_NAME.match(n) and user in n.lower().replace(" ", "").replace(".", "")), None)
            title, name = (title_near(page.text(entry), name), name) if name else academic(page.text(entry), email)
            out.append((email, name, title, text[:200]))
    return out


def hidden(page: _Page, html: str) -> list[tuple]:
    """``(email, method, confidence, context)`` hidden by styles, in base64 and in scripts; the first find of each address."""
    out = []
    for x in page.nodes:
        styled = any(s in x.attrs.get("style", "") for s in _HIDING_STYLES)
        if styled or any(c in x.attrs.get("class", "").split() for c in _HIDING_CLASSES):
            text = page.text(x, strip=True)
            out += [(e.lower(), "css_hidden", 0.7, text[:100]) for e in _EMAIL.findall(text)]
    for m in _BASE64.finditer(html):
        try:
            plain = base64.b64decode(m[0] + "==").decode("utf-8", errors="ignore")
        except ValueError:
            continue
        out += [(e.lower(), "base64_decoded", 0.8, m[0][:100]) for e in _EMAIL.findall(plain)]
    for x in page.nodes:
        script = page.text(x) if x.tag == "script" else ""
        out += [(f"{m[1]}@{m[2]}".lower(), "javascript", 0.75, m[0][:100]) for p in _JOINED for m in p.finditer(script)]
        out += [(m[1].lower(), "javascript", 0.75, m[0][:100]) for p in _ASSIGNED for m in p.finditer(script)]
    first: dict[str, tuple] = {}
    for hit in out:
        if is_email_strict(hit[0]):
            first.setdefault(hit[0], hit)
    return list(first.values())


def _rows(batches, kind: str, schema: pa.Schema):
    for batch in batches:
        rows = []
        for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            html = html or ""
            if kind != "hidden" and not has_at(html):
                continue
            try:
                page = _Page(html)
                found = hidden(page, html) if kind == "hidden" else staff(page) if kind == "staff" else markup_fields(page)
            except (ValueError, AssertionError, RecursionError) as e:  # one broken page is set aside, not the job
                rows.append((page_id, *[None] * (len(schema) - 2), repr(e)[:200]))
                continue
            rows += [(page_id, i, *x, None) for i, x in enumerate(found)]
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _read(pages: DataFrame, kind: str, columns: str) -> DataFrame:
    """What a page gives, a row each; a page that can't be read gives one row with its ``error`` alone."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    ddl = f"page_id long, ord int, {columns}, error string"
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")])
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(html as string) as html").mapInArrow(partial(_rows, kind=kind, schema=schema), ddl)


def _hits_with_markup(batches, schema: pa.Schema):
    for batch in batches:
        rows = []
        for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            html = html or ""
            try:
                page = _Page(html)
                hits = (H.structured_hits(page.root) if has_at(html) else []) or H.fallback_hits(page.root, html)
                marked = {x[0]: dict(zip(_FIELDS, x[1:], strict=True)) for x in markup_fields(page)} if hits else {}
            except (ValueError, AssertionError, RecursionError) as e:
                rows.append((page_id, None, None, None, None, None, repr(e)[:200]))
                continue
            text = page.text(page.root, " ").strip()
            rows += [(page_id, i, text, h[0].lower(), h[3], marked.get(h[0].lower()), None) for i, h in enumerate(hits)]
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_hits_with_markup(pages: DataFrame) -> DataFrame:
    """``page_id, ord, text, email, context, markup, error``: a page's hits and what its markup gives each, from one parse."""
    markup = pa.struct([(f, pa.string()) for f in _FIELDS])
    schema = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("text", pa.string()), ("email", pa.string()), ("context", pa.string()), ("markup", markup), ("error", pa.string())])
    ddl = f"page_id long, ord int, text string, email string, context string, markup struct<{','.join(f'{f}:string' for f in _FIELDS)}>, error string"
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(html as string) as html").mapInArrow(partial(_hits_with_markup, schema=schema), ddl)


def read_markup_fields(pages: DataFrame) -> DataFrame:
    """``page_id, ord, email`` and the ``name, title, phone, company`` its markup gives it (null: none)."""
    return _read(pages, "fields", "email string, name string, title string, phone string, company string")


def read_staff(pages: DataFrame) -> DataFrame:
    """``page_id, ord, email, name, title, context`` of staff lists."""
    return _read(pages, "staff", "email string, name string, title string, context string")


def read_hidden(pages: DataFrame) -> DataFrame:
    """``page_id, ord, email, method, confidence, context`` of addresses that a reader of the page doesn't see."""
    return _read(pages, "hidden", "email string, method string, confidence double, context string")

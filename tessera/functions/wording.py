"""Titles, companies, phone numbers and cues in running text, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import scalars as S

# Patterns and words that results depend on.
JOB_TITLES = (
    r"(?i)\b(CEO|CTO|CFO|COO|President|Vice President|VP|Director|Manager|Senior Manager)\b",
    r"(?i)\b(Software Engineer|Senior Software Engineer|Lead Engineer|Principal Engineer|Architect|Tech Lead)\b",
    r"(?i)\b(Business Analyst|Product Manager|Project Manager|Account Manager|Sales Manager)\b",
    r"(?i)\b(Marketing Manager|Digital Marketing Specialist|Content Manager|SEO Specialist)\b",
    r"\b(Senior|Junior|Lead|Principal|Chief)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Manager|Director|Engineer|Analyst|Specialist|Coordinator)\b",
)
COMPANY_NAMES = (
    r"\b([A-Z][A-Za-z\s&]+)\s+(?:Inc|Corp|LLC|Ltd|Co|Company|Corporation|Limited)\b\.?",
    r"(?i)\b(?:at|with)\s+([A-Z][A-Za-z\s&]+)(?:\s|$)",
    r'"([A-Z][A-Za-z\s&]+)"',
    r"\b([A-Z][A-Za-z]+(?:\s+[A-Z&][A-Za-z]*){1,3})\b",
)
HIDDEN_PHONES = (
    r"(\d{3})\.(\d{3})\.(\d{4})",
    r"(\d{3})\s+(\d{3})\s+(\d{4})",
    r"(\d{3})-(\d{3})\.(\d{4})",
    r"(?i)(\d{3})\s*dash\s*(\d{3})\s*dash\s*(\d{4})",
)
CUES = {
    "contact": (r"(?i)\b(?:contact|reach|email|call|phone|tel|mobile|office)\b", r"(?i)\b(?:get in touch|reach out|contact us|call us)\b", r"(?i)\b(?:for more information|questions|inquiries)\b"),
    "role": (r"(?i)\b(?:position|title|role|job|work as|serves as)\b", r"(?i)\b(?:responsible for|manages|leads|heads)\b"),
    "company": (r"(?i)\b(?:works at|employed by|company|organization|firm)\b", r"(?i)\b(?:member of|part of|team at)\b"),
    "location": (r"(?i)\b(?:located in|based in|office in|address)\b", r"(?i)\b(?:city|state|country|zip|postal)\b"),
}
WINDOW_TITLES = ("professor", "director", "manager", "engineer", "analyst")
WINDOW = 3


def _every(text: Column, patterns: tuple[str, ...], group: int) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(group)) for p in patterns]))


def job_titles(text: Column) -> Column:
    """All titles by six patterns, in the patterns' order."""
    return _every(text, JOB_TITLES, 0)


def company_names(text: Column) -> Column:
    """All names by four patterns, in the patterns' order."""
    return F.transform(_every(text, COMPANY_NAMES, 1), F.trim)


def hidden_phones(text: Column) -> Column:
    """Numbers written with other marks than dashes, as ``555-123-4567``, by four patterns in their order."""
    parts = [[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(g)) for g in (1, 2, 3)] for p in HIDDEN_PHONES]
    return F.flatten(F.array(*[F.transform(F.arrays_zip(*x), lambda z: F.concat_ws("-", z["0"], z["1"], z["2"])) for x in parts]))


def has_cue(text: Column, kind: str) -> Column:
    """Whether a text has a word that tells of a contact, role, company or place."""
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(p) for p in CUES[kind]])


def title_in_window(text: Column, name: Column, width: int = WINDOW) -> Column:
    """The first title word among the tokens of a name and ``width`` on either side of it; empty if there is none."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+|(?=\p{Punct})|(?<=\p{Punct})"), lambda w: F.trim(w) != "")
    tokens, own = words(text), words(name)
    n = F.size(own)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n) == own)
    first = F.get(at, F.lit(0))
    begin = F.greatest(first - width, F.lit(1))
    near = F.filter(F.slice(tokens, begin, first + n + width - begin), lambda w: F.lower(w).isin(*WINDOW_TITLES))
    return F.when((n == 0) | first.isNull(), F.lit("")).otherwise(F.coalesce(S.title_case(F.get(near, F.lit(0))), F.lit("")))


def is_disposable(email: Column) -> Column:
    """Whether an address is at a provider of throw-away addresses; such contacts are marked, not rejected."""
    return F.coalesce(S.domain(email).isin(*P.DISPOSABLE), F.lit(False))

"""Rules over free text and over candidate names, titles and organisations, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import scalars as S

# Fixed values.
TITLE_PREFIXES = r"(?i)^(position:|title:|role:|job:)"
NOT_LIKELY = ("email", "contact", "info", "admin", "support", "sales", "marketing", "webmaster", "help", "service", "team")
NOT_CONFIDENT = ("consultation", "info", "contact", "admin", "support", "department", "faculty", "office", "secretary", "email", "phone", "address", "university", "college")
CONFIDENT_TITLES = ("professor", "prof", "prof.", "associate professor", "assistant professor", "dr", "dr.", "director", "manager", "head", "dean", "chair", "lecturer")
ORGANISATIONS = ("university", "college", "institute", "corporation", "company", "inc", "ltd", "llc")
SCHOOLS = ("university", "college", "institute")
NOT_ORGANISATIONS = ("email", "contact", "phone", "address", "website")
NOISE = ("department", "university", "college", "prof", "dr", "email", "computer", "engineering", "science", "faculty", "staff", "institute", "school", "center", "office", "building")
STRICT_TITLES = (r"\b(Professor)\b", r"\b(Associate Professor)\b", r"\b(Assistant Professor)\b", r"\b(Dr\.)\b", r"\b(Director)\b", r"\b(Manager)\b", r"\b(Dean)\b", r"\b(Chair)\b")
LOOSE_TITLES = ("Professor", r"Prof\.?", "Associate Professor", "Assistant Professor", r"Dr\.?", "PhD", "Director", "Manager", "Engineer", "Analyst", "Lecturer", "Research Assistant", r"Senior\s+\w+", r"Lead\s+\w+")
COMPLETE_PHONES = (
    r"\+\d{1,3}\s*\(\d{3}\)\s*\d{3}\s*\d{2}\s*\d{2}(?:\s*/\s*\d{3,4})?",
    r"\+\d{1,3}\s*\d{3}\s*\d{3}\s*\d{2}\s*\d{2}",
    r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}",
    r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def _holds(c: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: c.contains(w))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _user(email: Column) -> Column:
    return F.lower(F.get(F.split(email, "@"), F.lit(0)))


def sentences_around(text: Column, email: Column, beside: int = 2) -> Column:
    """The sentence that holds the address's first occurrence with ``beside`` on each side.

    Every run of end marks counts as one character, so behind longer runs the
    sentence may be a later one; if none is left, 100 characters each side.
    Empty for a null or a text without the address.
    """
    at = F.instr(F.lower(text), F.lower(email)) - 1
    sentences = F.split(text, r"[.!?]+", -1)
    zero = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("i"), F.lit(-1).alias("found"))

    def step(s: Column, x: Column) -> Column:
        end = s["begin"] + F.length(x)
        here = (s["found"] < 0) & at.between(s["begin"], end)
        return F.struct((end + 1).alias("begin"), (s["i"] + 1).alias("i"), F.when(here, s["i"]).otherwise(s["found"]).alias("found"))

    k = F.aggregate(sentences, zero, step, lambda s: s["found"])
    first = F.greatest(k - beside, F.lit(0))
    chosen = F.filter(F.transform(F.slice(sentences, first + 1, k + beside + 1 - first), strip), lambda x: x != "")
    begin = F.greatest(at - 100, F.lit(0))
    near = F.substring(text, begin + 1, at + 100 - begin)
    return F.when(_true((at >= 0) & (F.length(email) > 0)), F.when(k >= 0, F.array_join(chosen, ". ")).otherwise(near)).otherwise("")


def between(text: Column, start: str, end: str = "") -> Column:
    """All non-empty texts between the markers, stripped; up to the line's end without an end marker."""
    if not start:
        return F.array().cast("array<string>")
    pattern = f"(?s){re.escape(start)}(.*?){re.escape(end)}" if end else f"{re.escape(start)}([^\n]*)"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def structured(text: Column, patterns: dict[str, str]) -> Column:
    """Map of each name to all matches of its pattern; names without a match are left out."""
    pairs = [x for name, p in patterns.items() for x in (F.lit(name), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def clean_title(title: Column) -> Column:
    """Without a leading label, capitalised but for small words; null if nothing is left."""
    bare = strip(F.regexp_replace(S.squeeze(title), TITLE_PREFIXES, ""))
    words = F.transform(_words(bare), lambda w: F.regexp_replace(w, "^[.,]+|[.,]+$", ""))
    cased = F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*P.SMALL_TITLE_WORDS), F.lower(w)).otherwise(S.capitalize(w)))
    return F.when(F.size(cased) > 0, F.array_join(cased, " "))


def clean_email(email: Column) -> Column:
    """Trimmed and lower-cased; empty if malformed."""
    c = F.lower(strip(email))
    return F.when(_true(c.rlike(P.EMAIL_WHOLE)), c).otherwise("")


def likely_person(c: Column) -> Column:
    """2 to 50 characters, 70 percent letters, a capital first, none of the role words."""
    letters = F.length(F.regexp_replace(c, r"\P{L}", "")) / F.length(c)
    role = F.exists(_words(F.lower(c)), lambda w: w.isin(*NOT_LIKELY))
    return _true(F.length(c).between(2, 50) & (letters >= 0.7) & c.rlike(r"^\p{Lu}") & ~role)


def confident_name(c: Column) -> Column:
    """Two to four alphabetic words with a capital first, none of the words of offices."""
    words = _words(c)
    shaped = F.forall(words, lambda w: w.rlike(r"^\p{Lu}\p{L}+$"))
    return _true(F.size(words).between(2, 4) & ~_holds(F.lower(c), NOT_CONFIDENT) & shaped)


def confident_title(c: Column) -> Column:
    return _true(F.lower(strip(c)).isin(*CONFIDENT_TITLES))


def confident_company(c: Column) -> Column:
    return _true((F.length(strip(c)) >= 3) & _holds(F.lower(c), ORGANISATIONS))


def valid_organization(c: Column) -> Column:
    return _true((F.length(strip(c)) >= 5) & ~_holds(F.lower(c), NOT_ORGANISATIONS))


def without_noise(name: Column) -> Column:
    """The name without words of departments and single letters; empty under two words."""
    words = F.filter(_words(name), lambda w: ~F.lower(w).isin(*NOISE) & (F.length(w) > 1))
    return F.when(F.size(words) >= 2, F.array_join(words, " ")).otherwise("")


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def name_fits(name: Column, email: Column) -> Column:
    """Whether a word of over two letters, or the initials, occur in the local part."""
    words, user = _words(F.lower(name)), _user(email)
    word = F.exists(words, lambda w: (F.length(w) > 2) & user.contains(w))
    return _true((F.size(words) >= 2) & (word | user.contains(_initials(words))))


def name_fits_strictly(name: Column, email: Column) -> Column:
    """Two or more capitalised words, one of three or more letters in the local part."""
    words, user = _words(name), _user(email)
    shaped = F.forall(words, lambda w: w.rlike(r"^\p{Lu}\p{Ll}+$"))
    return _true((F.size(words) >= 2) & shaped & F.exists(words, lambda w: (F.length(w) >= 3) & user.contains(F.lower(w))))


def name_score(name: Column, email: Column) -> Column:
    """1 for a local part in the name or the reverse, 0.5 a matching word, 0.3 for initials."""
    low, user = F.lower(name), _user(email)
    words, joined = _words(low), F.replace(low, F.lit(" "), F.lit(""))
    whole = F.when(user.contains(joined) | joined.contains(user), 1.0).otherwise(0.0)
    hits = F.size(F.filter(words, lambda w: (F.length(w) > 2) & user.contains(w))) * 0.5
    initials = F.when((F.size(words) >= 2) & user.contains(_initials(words)), 0.3).otherwise(0.0)
    return whole + hits + initials


def best_name(names: Column, email: Column) -> Column:
    """The best-scored candidate, the larger string of equals; the first if none scores; empty without any."""
    best = F.array_max(F.transform(names, lambda n: F.struct(name_score(n, email).alias("score"), n.alias("name"))))
    return F.coalesce(F.when(best["score"] > 0, best["name"]).otherwise(F.get(names, F.lit(0))), F.lit(""))


def best_organization(names: Column) -> Column:
    """The first school of the candidates, else the first one, else empty."""
    schools = F.filter(names, lambda n: _holds(F.lower(n), SCHOOLS))
    return F.coalesce(F.get(schools, F.lit(0)), F.get(names, F.lit(0)), F.lit(""))


def _first_of(text: Column, patterns, group: int, keep=lambda c: F.lit(True)) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns]
    return F.coalesce(*[F.when(keep(c), c) for c in found], F.lit(""))


def strict_title(text: Column) -> Column:
    """The first of eight titles, in their order."""
    return _first_of(text, ["(?i)" + p for p in STRICT_TITLES], 1)


def loose_title(text: Column) -> Column:
    """The first of the wider titles, in their order, also within words."""
    return _first_of(text, ["(?i)" + p for p in LOOSE_TITLES], 0)


def complete_phone(text: Column) -> Column:
    """The first number of ten or more digits by four formats, in their order."""
    return strip(_first_of(text, COMPLETE_PHONES, 0, lambda c: F.length(F.regexp_replace(c, r"\D", "")) >= 10))


def export_name(url: Column, at: Column) -> Column:
    """``contacts_<host>_<time>``: the host (with its port) without ``www.``, dots as underscores."""
    host = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    bare = F.replace(F.replace(host, F.lit("www."), F.lit("")), F.lit("."), F.lit("_"))
    return F.concat(F.lit("contacts_"), bare, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))

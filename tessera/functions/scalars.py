"""Scalar rules over contact fields as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import patterns as P


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 20)))


def domain(email: Column) -> Column:
    return F.get(F.split(email, "@"), F.lit(1))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first letter and the rest lower."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")


def is_email(email: Column) -> Column:
    """5 to 254 characters, one ``@``, a dotted domain, plain characters only."""
    one = F.length(email) - F.length(F.replace(email, F.lit("@"), F.lit(""))) == 1
    return F.coalesce(F.length(email).between(5, 254) & one & email.rlike(P.EMAIL_WHOLE), F.lit(False))


def is_email_strict(email: Column) -> Column:
    """As ``is_email``, with a local part of up to 64 characters and no stray dots, dashes or underscores at the edges."""
    parts = F.split(email, "@")
    bad = _any(email.rlike(p) for p in P.STRICT_INVALID_EMAILS)
    return is_email(email) & F.coalesce((F.length(F.get(parts, F.lit(0))) <= 64) & (F.length(F.get(parts, F.lit(1))) <= 255) & ~bad, F.lit(False))


def email_score(email: Column) -> Column:
    """0.5, plus 0.2 for a reputable domain, 0.1 for the format and 0.1 for an address that isn't generic."""
    host = F.lower(domain(email))
    good = F.when(_any(host.contains(x) for x in P.REPUTABLE), F.lit(0.2)).otherwise(F.lit(0.0))
    form = F.when(email.rlike(P.EMAIL_WHOLE), F.lit(0.1)).otherwise(F.lit(0.0))
    own = F.when(~_any(F.lower(email).contains(x) for x in P.GENERIC), F.lit(0.1)).otherwise(F.lit(0.0))
    score = F.lit(0.5) + good + form + own
    return F.when(F.coalesce(email, F.lit("")) == "", F.lit(0.5)).when(host.isNull(), F.lit(0.5)).otherwise(F.least(score, F.lit(1.0)))


def name_from_email(email: Column) -> Column:
    """``first.last`` and ``first_last``; else an initial and a last name; else the parts capitalised."""
    user = F.lower(F.get(F.split(email, "@"), F.lit(0)))
    first = F.coalesce(*[F.nullif(F.regexp_extract(user, p, 1), F.lit("")) for p in _NAME_SHAPES])
    last = F.coalesce(*[F.nullif(F.regexp_extract(user, p, 2), F.lit("")) for p in _NAME_SHAPES])
    pair = F.when(F.length(first) == 1, F.concat(F.upper(first), F.lit(". "), capitalize(last))).otherwise(F.concat(capitalize(first), F.lit(" "), capitalize(last)))
    rest = F.array_join(F.transform(F.split(F.get(F.split(email, "@"), F.lit(0)), "[._-]"), capitalize), " ")
    return F.when(first.isNotNull(), pair).otherwise(rest)


_NAME_SHAPES = (r"^([a-z]+)\.([a-z]+)$", r"^([a-z]+)_([a-z]+)$", r"^([a-z])([a-z]{3,})$")


def company_from_domain(host: Column) -> Column:
    label = lambda c: title_case(F.replace(F.get(F.split(c, r"\."), F.lit(0)), F.lit("-"), F.lit(" ")))
    edu = F.concat(label(F.replace(host, F.lit(".edu"), F.lit(""))), F.lit(" University"))
    return F.when(host.contains(".edu"), edu).otherwise(label(F.replace(host, F.lit("www."), F.lit(""))))


def institution(url: Column, host: Column) -> Column:
    """The institution of an ``.edu`` domain, else of the page's host, else ``Unknown``."""
    name = title_case(F.replace(F.get(F.split(F.replace(host, F.lit(".edu"), F.lit("")), r"\."), F.lit(0)), F.lit("-"), F.lit(" ")))
    edu = F.when(F.lower(name).contains("university"), name).otherwise(F.concat(name, F.lit(" University")))
    site = F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))
    bare = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), ("www.", ".com", ".edu"), site)
    known = site.contains("university") | site.contains("college") | site.contains(".edu")
    return F.when(host.contains(".edu"), edu).when(known, title_case(F.replace(bare, F.lit("-"), F.lit(" ")))).otherwise("Unknown")


def _first(text: Column, patterns, group: int = 1) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def phone_in(text: Column) -> Column:
    return F.trim(F.regexp_extract(squeeze(text), "(?U)" + P.PHONE, 0))


def name_in(text: Column, email: Column) -> Column:
    """A name after an academic or job title, else the one inferred from the address."""
    def titled(p: str) -> Column:
        c = F.nullif(F.regexp_extract(squeeze(text), "(?U)" + p, 1), F.lit(""))
        return F.when(~_any(F.lower(c).contains(w) for w in P.NOT_IN_NAMES), c)

    return F.coalesce(*[titled(p) for p in P.TITLED_NAMES], name_from_email(email))


def title_in(text: Column) -> Column:
    return F.coalesce(_first(squeeze(text), ["(?iU)" + p for p in P.TITLES]), F.lit(""))


def company_in(text: Column, email: Column) -> Column:
    return F.coalesce(_first(squeeze(text), ["(?iU)" + p for p in P.COMPANIES]), company_from_domain(domain(email)))


def valid_email(email: Column) -> Column:
    """Trimmed and lower-cased; null if malformed."""
    c = F.lower(F.trim(email))
    return F.when(~_any(c.rlike(p) for p in P.INVALID_EMAILS) & c.rlike(P.EMAIL_WHOLE), c)


def _mostly(c: Column, allowed: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{allowed}]", "")) / F.length(c) >= 0.8


def valid_name(name: Column) -> Column:
    """Capitalised name (``O'X`` and ``McX`` kept), or null."""
    c = squeeze(name)
    def part(w: Column) -> Column:
        quoted = F.array_join(F.transform(F.split(w, "'"), capitalize), "'")
        mc = F.concat(F.lit("Mc"), capitalize(F.substring(w, 3, 1 << 20)))
        return F.when(w.contains("'"), quoted).when(F.lower(w).startswith("mc"), mc).otherwise(capitalize(w))

    ok = F.length(c).between(2, 100) & ~_any(c.rlike("(?iU)" + p) for p in P.NOT_NAMES) & _mostly(c, r"\p{L}\s'.\-")
    return F.when(ok, F.array_join(F.transform(F.split(c, " "), part), " "))


def valid_phone(phone: Column) -> Column:
    c = F.trim(F.regexp_replace(phone, r"[^\d+()\-\s]", ""))
    digits = F.length(F.regexp_replace(c, r"[^\d]", ""))
    return F.when(digits.between(7, 15) & _any(c.rlike(p) for p in P.PHONE_FORMATS), c)


def valid_title(title: Column) -> Column:
    c = squeeze(title)
    words = F.transform(F.split(c, " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(*P.SMALL_TITLE_WORDS), F.lower(w)).otherwise(capitalize(w)))
    return F.when(F.length(c).between(2, 100) & _mostly(c, r"\p{L}\p{N} \-&/()."), F.array_join(words, " "))


def valid_company(company: Column) -> Column:
    c = squeeze(company)
    word = lambda w: F.when(F.upper(w).isin(*P.UPPER_COMPANY_WORDS), F.upper(w)).when(F.lower(w).isin(*P.SMALL_COMPANY_WORDS), F.lower(w)).otherwise(capitalize(w))
    return F.when(F.length(c).between(2, 100) & _mostly(c, r"\p{L}\p{N} \-&.,()'/"), F.array_join(F.transform(F.split(c, " "), word), " "))


def contact_score(name: Column, phone: Column, title: Column, company: Column, confidence: Column) -> Column:
    """0.3, plus 0.2, 0.2, 0.15 and 0.15 for the fields that are there, times the extraction's confidence."""
    add = lambda c, x: F.when(F.coalesce(c, F.lit("")) != "", F.lit(x)).otherwise(F.lit(0.0))
    score = F.lit(0.3) + add(name, 0.2) + add(phone, 0.2) + add(title, 0.15) + add(company, 0.15)
    return F.least(F.lit(1.0), score * F.coalesce(confidence, F.lit(0.5)))


def clean_name(name: Column) -> Column:
    """Without honorifics and suffixes, capitalised; null if nothing is left."""
    words = F.transform(F.split(F.lower(squeeze(name)), " "), lambda w: F.regexp_replace(w, "^[.,]+|[.,]+$", ""))
    out = F.array_join(F.transform(F.filter(words, lambda w: ~w.isin(*P.HONORIFICS)), capitalize), " ")
    return F.nullif(out, F.lit(""))


def clean_phone(phone: Column) -> Column:
    c = F.regexp_replace(phone, r"[^\d+]", "")
    n = F.length(c)
    piece = lambda a, b: F.substring(c, a, b)
    us = F.concat(F.lit("+1 ("), piece(3, 3), F.lit(") "), piece(6, 3), F.lit("-"), piece(9, 20))
    local = F.concat(F.lit("("), piece(1, 3), F.lit(") "), piece(4, 3), F.lit("-"), piece(7, 20))
    return F.when(n.between(7, 15), F.when(c.startswith("+1") & (n == 12), us).when(n == 10, local).otherwise(c))


def clean_company(company: Column) -> Column:
    suffix = F.create_map(*[F.lit(x) for kv in P.COMPANY_SUFFIXES.items() for x in kv])
    words = F.transform(F.split(squeeze(company), " "), lambda w: F.regexp_replace(w, "^[.,]+|[.,]+$", ""))
    out = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(suffix, F.lower(w)), capitalize(w)))
    return F.nullif(F.array_join(out, " "), F.lit(""))


def email_domain(email: Column) -> Column:
    c = F.regexp_replace(F.lower(domain(email)), r"[^a-z0-9.\-].*$", "")
    return F.when(c.contains("."), c)


def truncate(text: Column, most: int = 200, suffix: str = "...") -> Column:
    """Cut at a blank if one lies in the last 30 percent, with a suffix; short texts stay."""
    head = F.substring(text, 1, most - len(suffix))
    blank = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(F.reverse(head), " ") > 0) & (blank > most * 0.7), F.substring(head, F.lit(1), blank.cast("int"))).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit(suffix)))


def single_spaces(text: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), " +", " "), r"\n+", "\n"), F.lit("\t"), F.lit(" ")))


def export_text(c: Column) -> Column:
    """Null as empty, line breaks as blanks, 1000 characters at most."""
    return F.substring(F.translate(F.coalesce(c, F.lit("")), "\n\r", "  "), 1, 1000)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def may_crawl(url: Column, base: Column, depth: Column, most_depth: int = 3, allowed: tuple[str, ...] = (), excluded: tuple[str, ...] = (), extensions: tuple[str, ...] = P.EXCLUDED_EXTENSIONS) -> Column:
    """Same host, below the depth limit, a host among the ``allowed`` ones (if there are any) and not ``excluded``, no excluded file type, no page number over 100."""
    host = F.try_parse_url(url, F.lit("AUTHORITY"))
    listed = (host.isin(*allowed) if allowed else F.lit(True)) & (~host.isin(*excluded) if excluded else F.lit(True))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    page = F.try_parse_url(url, F.lit("QUERY"), F.lit("page")).try_cast("int")
    return (depth < most_depth) & F.coalesce((host == base) & listed, F.lit(False)) & ~reduce(lambda a, b: a | b, [path.endswith(x) for x in extensions], F.lit(False)) & F.coalesce(page <= 100, F.lit(True))


def is_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("AUTHORITY"))) > 0), F.lit(False))


def looks_like_name(c: Column) -> Column:
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    ok = F.length(c).between(2, 50) & c.rlike(r"^[A-Za-z\s.']+$") & F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike("^[A-Z]"))
    return F.coalesce(ok, F.lit(False))

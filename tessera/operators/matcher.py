"""Contact fields read from the text near an address, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S

# Fixed values.
NAMES = (
    r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b",
    r"\b([A-Z][a-z]+\s+[A-Z][a-z]+\s+[A-Z][a-z]+)\b",
    r"\b(?:Dr|Mr|Ms|Mrs|Prof)\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b",
    r"\b([A-Z][a-z]+\s+[A-Z][a-z]+),",
)
NOT_PERSONS = ("email", "contact", "info", "admin", "webmaster", "support", "sales", "marketing", "hr", "privacy", "legal")
PHONES = (
    (r"\((\d{3})\)\s*(\d{3})-(\d{4})", 3),
    (r"\+(\d{1,3})-(\d{3})-(\d{3})-(\d{4})", 4),
    (r"(\d{3})-(\d{3})-(\d{4})", 3),
    (r"(\d{3})\.(\d{3})\.(\d{4})", 3),
    (r"(\d{3})\s+(\d{3})\s+(\d{4})", 3),
    (r"\+(\d{1,3})\s*\((\d{1,4})\)\s*(\d{3,4})-?(\d{4})", 4),
)
LABELS = {"name": ("name",), "title": ("title", "position", "role"), "company": ("company", "organization"), "phone": ("phone", "tel")}
CONTACT_PAGE = ("contact us", "get in touch", "our team", "staff directory")
SECOND_LEVEL = ("co", "com", "net", "org")


def is_person(name: Column) -> Column:
    """2 to 100 characters, 70 percent letters, none of the role words."""
    share = F.length(F.regexp_replace(name, r"\P{L}", "")) / F.length(name)
    return F.coalesce(F.length(name).between(2, 100) & (share >= 0.7) & ~F.lower(name).isin(*NOT_PERSONS), F.lit(False))


def names_in(text: Column) -> Column:
    """All names by the four patterns in their order, white space squeezed."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NAMES]))
    return F.filter(F.transform(found, S.squeeze), is_person)


def phones_in(text: Column) -> Column:
    """All phone numbers by the patterns in their order, their groups joined by dashes."""
    def by(pattern: str, groups: int) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        return F.transform(F.arrays_zip(*parts), lambda z: F.concat_ws("-", *[z[str(i)] for i in range(groups)]))

    return F.flatten(F.array(*[by(p, n) for p, n in PHONES]))


def label_in(text: Column, field: str) -> Column:
    """The value after a ``label:`` line; a later label of the field wins over an earlier one."""
    most = 30 if field == "phone" else 50
    found = [F.nullif(F.trim(F.regexp_extract(text, rf"(?i){label}\s*[:]\s*([^\n\r]{{2,{most}}})", 1)), F.lit("")) for label in LABELS[field]]
    return F.coalesce(*found[::-1])


def is_contact_page(title: Column, text: Column) -> Column:
    words = [F.lower(text).contains(w) for w in CONTACT_PAGE]
    return F.coalesce(title.rlike("(?i)contact|about|team|staff"), F.lit(False)) | F.coalesce(words[0] | words[1] | words[2] | words[3], F.lit(False))


def name_of_address(email: Column) -> Column:
    """``first.last``, else the letters of the local part if there are three or more."""
    local = F.get(F.split(email, "@"), F.lit(0))
    parts = F.transform(F.split(local, r"\."), lambda p: S.capitalize(F.regexp_replace(p, "[^a-zA-Z]", "")))
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    single = S.capitalize(F.regexp_replace(local, "[^a-zA-Z]", ""))
    return F.when((F.size(parts) == 2) & (F.length(first) > 1) & (F.length(last) > 1), F.concat_ws(" ", first, last)).when(F.length(single) > 2, single)


def company_of_address(email: Column) -> Column:
    """The label under the public suffix, with second-level suffixes such as ``co.uk`` skipped."""
    parts = F.split(F.lower(S.domain(email)), r"\.")
    second = F.try_element_at(parts, F.lit(-2))
    label = F.when(F.size(parts) <= 2, F.get(parts, F.lit(0))).when(second.isin(*SECOND_LEVEL), F.try_element_at(parts, F.lit(-3))).otherwise(second)
    return F.array_join(F.transform(F.filter(F.split(F.regexp_replace(label, "[-_]", " "), " "), lambda w: w != ""), S.capitalize), " ")


def match_contacts(hits: DataFrame, page_text: str = "text", context: str = "context", title: str | None = None, markup: str | None = None) -> DataFrame:
    """Hits with ``name, phone, title, company`` filled in.

    The text round the address comes first, then what the page's markup gives it
    (``markup``: a struct column of the four fields), then the labels of contact
    pages, then what the address itself suggests; present values are kept.
    """
    near, page = F.col(context), F.col(page_text)
    contact_page = is_contact_page(F.col(title) if title else F.lit(None).cast("string"), page)
    labelled = {f: F.when(contact_page, label_in(page, f)) for f in LABELS}
    had = lambda c: F.nullif(F.col(c), F.lit("")) if c in hits.columns else F.lit(None).cast("string")
    marked = lambda f: F.nullif(F.col(markup)[f], F.lit("")) if markup else F.lit(None).cast("string")
    email = F.col("email")
    return hits.withColumns(
        {
            "name": F.coalesce(had("name"), F.get(names_in(near), F.lit(0)), marked("name"), labelled["name"], name_of_address(email)),
            "phone": F.coalesce(had("phone"), F.get(phones_in(near), F.lit(0)), marked("phone"), labelled["phone"]),
            "title": F.coalesce(had("title"), marked("title"), labelled["title"]),
            "company": F.coalesce(had("company"), marked("company"), labelled["company"], company_of_address(email)),
        }
    )

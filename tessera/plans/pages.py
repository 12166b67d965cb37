"""Stored pages to contacts: parse, extract, read fields, score, keep the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import contacts as C
from tessera.sources.html import read_pages


def hits(pages: DataFrame) -> DataFrame:
    """Email hits of all pages with the fields read from their context."""
    rows = read_pages(pages, ("hits",)).select("page_id", F.col("url").alias("source_url"), F.posexplode("hits").alias("ord", "h")).select("page_id", "source_url", "ord", "h.*")
    email, text = F.col("email"), F.col("fields_text")
    read = lambda c: F.when(text.isNotNull(), c).otherwise("")
    inferred = lambda c, other: F.when(F.col("fallback"), other).otherwise(read(c))
    return rows.select(
        "page_id",
        "source_url",
        "ord",
        F.lower(email).alias("email"),
        inferred(S.name_in(text, email), S.name_from_email(email)).alias("name"),
        read(S.title_in(text)).alias("title"),
        inferred(S.company_in(text, email), S.institution(F.col("source_url"), S.domain(email))).alias("company"),
        read(S.phone_in(text)).alias("phone"),
        "method",
        "confidence",
        "context",
    )


def page_contacts(pages: DataFrame) -> DataFrame:
    """The best hit of each page and address, scored."""
    best = C.best_per_page(hits(pages), "page_id", "ord")
    return best.withColumn("validation_score", S.email_score(F.col("email"))).withColumnRenamed("method", "extraction_method")


def site_contacts(pages: DataFrame) -> DataFrame:
    """One contact per site and address, the best-scored."""
    found = page_contacts(pages).withColumn("site", F.try_parse_url("source_url", F.lit("AUTHORITY"))).withColumn("_o", F.struct("page_id", "ord"))
    return C.deduplicate(found, "site", order="_o").drop("_o")


def process_results(contacts: DataFrame, order: str, validate: bool = True) -> DataFrame:
    """Contacts of a crawl as they are exported: validated (if asked for), one per address, cleaned."""
    found = C.with_validated(contacts) if validate else contacts
    return C.export_rows(C.deduplicate(found, order=order))


def link_edges(pages: DataFrame) -> DataFrame:
    return read_pages(pages, ("links",)).select("page_id", F.col("url").alias("src"), F.posexplode("links").alias("ord", "dst"))

"""Relational operators over email hits and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import scalars as S
from tessera.scratch import stored


def scan_emails(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """A row per address found in a text: ``keys, ord, email, context, method, confidence``.

    ``context`` is 150 characters round the address's first occurrence.
    """
    found = rows.select(*keys, F.col(text).alias("_t"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(P.EMAIL), F.lit(0))).alias("ord", "_raw"))
    found = found.filter(S.is_email(F.lower("_raw")))
    at = F.expr("instr(_t, _raw)")
    begin = F.greatest(at - 150, F.lit(1))
    stop = at + F.length("_raw") + 150
    context = F.trim(F.substring(F.col("_t"), begin, stop - begin))
    return found.select(*keys, "ord", F.lower("_raw").alias("email"), context.alias("context"), F.lit("text_pattern").alias("method"), F.lit(0.75).alias("confidence"))


def _address(parts: int):
    return lambda z: F.lower(F.concat(z["0"], F.lit("@"), F.concat_ws(".", *[z[str(g)] for g in range(1, parts)])))


def deobfuscate(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """Addresses hidden by ``[at]``, ``(dot)`` and the like: ``keys, rule, email``."""
    rules = []
    for i, p in enumerate(P.OBFUSCATED):
        groups = range(1, p.count("(") - p.count("(?") - p.count(r"\(") + 1)
        found = [F.regexp_extract_all(F.col(text), F.lit(p), F.lit(g)) for g in groups]
        joined = F.transform(F.arrays_zip(*found), _address(len(found)))
        rules.append(F.struct(F.lit(i).alias("rule"), joined.alias("emails")))
    out = rows.select(*keys, F.explode(F.array(*rules)).alias("r")).select(*keys, "r.rule", F.explode("r.emails").alias("email"))
    return out.filter(S.is_email_strict(F.col("email")))


def standard_emails(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """Addresses by the four standard patterns in their order: ``keys, pattern, email, confidence``."""
    arrays = [F.struct(F.lit(n).alias("pattern"), F.lit(c).alias("confidence"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)).alias("e")) for n, p, c in P.STANDARD]
    out = rows.select(*keys, F.explode(F.array(*arrays)).alias("r")).select(*keys, "r.pattern", "r.confidence", F.explode("r.e").alias("email"))
    return out.withColumn("email", F.lower("email")).filter(S.is_email_strict(F.col("email")))


def filled(*names: str) -> Column:
    """How many of the columns hold more than blanks."""
    return sum((F.when(F.length(F.trim(F.col(n))) > 0, 1).otherwise(0) for n in names), F.lit(0))


def best_per_page(hits: DataFrame, page: str, order: str) -> DataFrame:
    """Per page and address the hit with the most filled fields, the first of equals."""
    w = Window.partitionBy(page, F.lower("email")).orderBy(filled("name", "title", "company", "phone").desc(), order)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_validated(contacts: DataFrame) -> DataFrame:
    """Normalised fields and a score; rows without a valid address go.

    A rejected field keeps its raw value and only lowers the score, as the
    reference semantics have it.
    """
    rules = {"name": S.valid_name, "phone": S.valid_phone, "title": S.valid_title, "company": S.valid_company}
    out = contacts.withColumn("email", S.valid_email(F.col("email"))).filter("email is not null")
    out = out.withColumns({f"_{k}": f(F.col(k)) for k, f in rules.items()})
    out = out.withColumn("validation_score", S.contact_score(*[F.col(f"_{k}") for k in rules], F.col("confidence")))
    out = out.withColumns({k: F.coalesce(f"_{k}", F.nullif(F.col(k), F.lit(""))) for k in rules})
    return out.drop(*[f"_{k}" for k in rules])


def deduplicate(contacts: DataFrame, *site: str, order: str) -> DataFrame:
    """The best-scored contact of each address (case kept), per site; the first of equals."""
    w = Window.partitionBy(*site, "email").orderBy(F.coalesce("validation_score", F.lit(0.0)).desc(), order)
    return contacts.filter("email <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _percent(n: Column, total: Column) -> Column:
    return F.format_string("%.1f%%", n / total * 100)


def summary_by_method(contacts: DataFrame) -> DataFrame:
    total = contacts.agg(F.count("*").alias("total"))
    by = contacts.groupBy(F.coalesce("extraction_method", F.lit("unknown")).alias("type")).agg(F.count("*").alias("count"))
    return by.join(F.broadcast(total)).select(F.lit("Extraction Method").alias("category"), "type", "count", _percent(F.col("count"), F.col("total")).alias("percentage"))  # `total` is one row


def summary_top_companies(contacts: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The ``most`` most frequent companies; ties go to the one seen first."""
    total = contacts.agg(F.count("*").alias("total"))
    by = contacts.filter("company <> '' and company <> 'Unknown'").groupBy("company").agg(F.count("*").alias("count"), F.min(order).alias("_o"))
    top = by.orderBy(F.desc("count"), "_o").limit(most)
    return top.join(F.broadcast(total)).select(F.lit("Top Companies").alias("category"), F.col("company").alias("type"), "count", _percent(F.col("count"), F.col("total")).alias("percentage"))


def statistics(contacts: DataFrame) -> DataFrame:
    """One row of counts and averages; missing numbers count as 0."""
    n = F.count("*")
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    share = lambda c: F.when(n > 0, F.format_string("%d (%.1f%%)", has(c), has(c) / n * 100)).otherwise("0")
    mean = lambda c: F.when(n > 0, F.format_string("%.3f", F.sum(F.coalesce(F.col(c), F.lit(0.0))) / n)).otherwise("0")
    return contacts.agg(n.alias("total_contacts"), share("name").alias("with_names"), share("phone").alias("with_phone_numbers"), share("title").alias("with_job_titles"), share("company").alias("with_companies"), mean("confidence").alias("average_confidence"), mean("validation_score").alias("average_validation_score"))


def validation_stats(original: DataFrame, valid: DataFrame) -> DataFrame:
    a = original.agg(F.count("*").alias("total"))
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    b = valid.agg(F.count("*").alias("valid"), F.avg("validation_score").alias("mean_score"), *[has(c).alias(f"with_{c}") for c in ("name", "phone", "title", "company")])
    return a.join(F.broadcast(b)).select("*", (F.col("total") - F.col("valid")).alias("rejected"), F.when(F.col("total") > 0, (F.col("total") - F.col("valid")) / F.col("total")).otherwise(0.0).alias("rejection_rate"))


def social_profiles(links: DataFrame, url: str, *keys: str) -> DataFrame:
    """Links to profiles on seven platforms: ``keys, platform, url, username``."""
    tests = [F.when(F.col(url).rlike(p), F.struct(F.lit(n).alias("platform"), F.regexp_extract(url, p, 1).alias("username"))) for n, p in P.SOCIAL.items()]
    out = links.select(*keys, F.col(url).alias("url"), F.explode(F.array_compact(F.array(*tests))).alias("s"))
    return out.select(*keys, "s.platform", "url", F.col("s.username").alias("username"))


def export_rows(contacts: DataFrame) -> DataFrame:
    """The ten export columns, cleaned."""
    numbers = ("confidence", "validation_score")
    return contacts.select(*[F.col(c) if c in numbers else S.export_text(F.col(c)).alias(c) for c in P.EXPORT_COLUMNS])


def crm_leads(contacts: DataFrame) -> DataFrame:
    """Lead records as a map without empty fields."""
    words = F.filter(F.split(F.coalesce("name", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    last = F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, 1000), " ")).otherwise("Unknown")
    fields = {"Email": F.col("email"), "FirstName": F.get(words, F.lit(0)), "LastName": last, "Title": F.col("title"), "Company": F.col("company"), "Phone": F.col("phone"), "LeadSource": F.lit("Web Scraping"), "Description": F.concat(F.lit("Extracted from: "), F.coalesce("source_url", F.lit("")))}
    return contacts.select("email", F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: F.coalesce(v, F.lit("")) != "").alias("lead"))


def crm_contacts(contacts: DataFrame) -> DataFrame:
    """Contact properties as a map without empty fields."""
    words = F.filter(F.split(F.coalesce("name", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    fields = {"email": F.col("email"), "firstname": F.get(words, F.lit(0)), "lastname": F.array_join(F.slice(words, 2, 1000), " "), "jobtitle": F.col("title"), "company": F.col("company"), "phone": F.col("phone"), "hs_lead_status": F.lit("NEW"), "lifecyclestage": F.lit("lead")}
    return contacts.select("email", F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: F.coalesce(v, F.lit("")) != "").alias("properties"))


def crawl_levels(edges: DataFrame, seeds: DataFrame, most_depth: int = 3) -> DataFrame:
    """``node, depth``: breadth-first levels over ``edges(src, dst)`` from ``seeds(node)``, each node once.

    Every level is a stored table, so the plan doesn't grow with depth.
    """
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    level = seen = stored(seen)
    for depth in range(1, most_depth):
        step = level.join(edges, level.node == edges.src).select(F.col("dst").alias("node")).distinct()
        level = stored(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(level)
    return seen

"""Queries over the driver's tables, each with DuckDB SQL written on its own that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import scalars as S
from tessera.operators import contacts as C
from tessera.plans import pages as pages_plan

Query = Callable[[SparkSession, str], DataFrame]
TASK_ROWS = 5000

# Contacts made of customers and nations, in SQL that both engines read.
CONTACTS = """
select c_custkey * 3 + v.k as id,
  lower(replace(c_name, '#', '.')) || '@' || replace(lower(n_name), '_', '-') || case c_custkey % 3 when 0 then '.edu' when 1 then '.com' else '.org' end as email,
  case c_custkey % 6 when 0 then null when 1 then 'john o''neil' when 2 then 'mcdonald  ANNA' when 3 then 'Click here' when 4 then '' else 'dr. ada byron phd' end as name,
  case (c_custkey + v.k) % 5 when 0 then null when 1 then '(555) 123-4567' when 2 then '+15551234567' when 3 then '12' else '5551234567' end as phone,
  case (c_custkey + v.k) % 4 when 0 then 'director OF research' when 1 then null when 2 then 'senior engineer' else '!!' end as title,
  case c_custkey % 7 when 0 then null when 1 then 'acme llc' when 2 then 'University Of Ghent' when 3 then 'Unknown' else 'company ' || cast(c_custkey % 13 as varchar(9)) || ' inc.' end as company,
  'http://www.site' || cast(c_nationkey as varchar(9)) || '.com/p' as source_url,
  v.method as extraction_method, cast(v.confidence as double) as confidence
from customer join nation on c_nationkey = n_nationkey
cross join (values (0, 'table_structure', 0.9), (1, 'list_structure', 0.85), (2, 'text_pattern', 0.75)) as v(k, method, confidence)
where (c_custkey + v.k) % 3 <> 1
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, dealt out to tasks of about ``TASK_ROWS`` rows.

    Their rows are so short that a large table is one part of one file, which one task
    would read and do all work on.
    """
    rows = table(spark, sf_dir, "customer")
    n = rows.count()  # from the file's footer
    return rows.repartition(-(-n // TASK_ROWS)) if n > TASK_ROWS else rows


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTACTS.replace("from customer join nation", "from {customer} join {nation}"), customer=customers(spark, sf_dir), nation=table(spark, sf_dir, "nation"))


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_Q = lambda p: p.replace("'", "''")
_SQL_EMAIL = f"regexp_matches(email, '{P.EMAIL_WHOLE}') and length(email) between 5 and 254 and length(email) - length(replace(email, '@', '')) = 1"
_SCAN = """with raw as (select {key}, {text} as t, regexp_extract_all({text}, '{p}') as found from {table}),
each as (select {key}, t, generate_subscripts(found, 1) - 1 as ord, unnest(found) as r from raw),
ok as (select {key}, t, ord, r, lower(r) as email from each)
select {key}, cast(ord as int) as ord, email, trim(substring(t, greatest(instr(t, r) - 150, 1), instr(t, r) + length(r) + 150 - greatest(instr(t, r) - 150, 1)), ' ') as context, 'text_pattern' as method, cast(0.75 as double) as confidence
from ok where {valid}"""


@query(_SCAN.format(key="doc_id", text="text", table="documents", p=P.EMAIL, valid=_SQL_EMAIL))
def email_scan_documents(spark, sf_dir):
    """Addresses in documents with the text round them."""
    return C.scan_emails(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(_SCAN.format(key="page_id", text="regexp_replace(html, '<[^>]+>', ' ', 'g')", table="pages", p=P.EMAIL, valid=_SQL_EMAIL))
def email_scan_pages(spark, sf_dir):
    """Addresses in pages without their tags."""
    pages = table(spark, sf_dir, "pages").select("page_id", S.strip_tags(F.col("html")).alias("t"))
    return C.scan_emails(pages, "t", "page_id")


_BEST = """(select *, row_number() over (partition by email order by score desc, doc_id, ord) as n from (select doc_id, ord, email,
least(cast(0.5 as double) + case when split_part(email, '@', 2) like '%.edu%' or split_part(email, '@', 2) like '%.gov%' or split_part(email, '@', 2) like '%.org%' then cast(0.2 as double) else 0 end
 + cast(0.1 as double) + case when regexp_matches(email, 'info|contact|admin|support|noreply') then 0 else cast(0.1 as double) end, 1) as score from ({scan})))"""


@query("select doc_id, ord, email, score as validation_score from " + _BEST.format(scan=ORACLE_SQL["email_scan_documents"]) + " where n = 1")
def document_contacts(spark, sf_dir):
    """The best-scored occurrence of every address in the documents."""
    found = email_scan_documents(spark, sf_dir).withColumn("validation_score", S.email_score(F.col("email"))).withColumn("_o", F.struct("doc_id", "ord"))
    return C.deduplicate(found, order="_o").select("doc_id", "ord", "email", "validation_score")


@query(f"select id, email, {_SQL_EMAIL} as ok from (select c_custkey as id, case c_custkey % 6 when 0 then 'a@b' when 1 then 'a..b@x.com' when 2 then '.a@x.com' when 3 then 'a@@x.com' when 4 then 'a-@x.co' else 'c' || c_custkey || '@mail.org' end as email from customer)")
def email_validate_crawler(spark, sf_dir):
    df = _odd_emails(spark, sf_dir)
    return df.withColumn("ok", S.is_email(F.col("email")))


@query(f"select id, email, {_SQL_EMAIL} and not regexp_matches(email, '\\.{{2,}}|^\\.|\\.$|@\\.|\\.@|^-|^_|-$|_$') and length(split_part(email, '@', 1)) <= 64 as ok from (select c_custkey as id, case c_custkey % 6 when 0 then 'a@b' when 1 then 'a..b@x.com' when 2 then '.a@x.com' when 3 then 'a@@x.com' when 4 then 'a-@x.co' else 'c' || c_custkey || '@mail.org' end as email from customer)")
def email_validate_strict(spark, sf_dir):
    df = _odd_emails(spark, sf_dir)
    return df.withColumn("ok", S.is_email_strict(F.col("email")))


def _odd_emails(spark, sf_dir):
    odd = F.expr("case c_custkey % 6 when 0 then 'a@b' when 1 then 'a..b@x.com' when 2 then '.a@x.com' when 3 then 'a@@x.com' when 4 then 'a-@x.co' else concat('c', c_custkey, '@mail.org') end")
    return customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), odd.alias("email"))


@query(f"select id, email, case when regexp_matches(split_part(email, '@', 2), '\\.edu|\\.gov|\\.org') then cast(0.5 as double) + cast(0.2 as double) + cast(0.1 as double) + cast(0.1 as double) else cast(0.5 as double) + cast(0.1 as double) + cast(0.1 as double) end as score from ({CONTACTS})")
def email_confidence_score(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", "email", S.email_score(F.col("email")).alias("score"))


@query("""select id, u, case when regexp_matches(u, '^[a-z]+[._][a-z]+$') then case when length(regexp_extract(u, '^([a-z]+)', 1)) = 1 then upper(u[1]) || '. ' else upper(u[1]) || regexp_extract(u, '^.([a-z]*)', 1) || ' ' end || upper(regexp_extract(u, '[._](.)', 1)) || regexp_extract(u, '[._].(.*)$', 1)
 when regexp_matches(u, '^[a-z]{4,}$') then upper(u[1]) || '. ' || upper(u[2]) || substring(u, 3)
 else upper(u[1]) || regexp_extract(u, '^.([^._-]*)', 1) || ' ' || regexp_extract(u, '[._-](.*)$', 1) end as name
from (select c_custkey as id, case c_custkey % 5 when 0 then 'john.smith' when 1 then 'jsmith' when 2 then 'a_byron' when 3 then 'john' else 'ann-' || c_custkey end as u from customer)""")
def name_from_email(spark, sf_dir):
    u = F.expr("case c_custkey % 5 when 0 then 'john.smith' when 1 then 'jsmith' when 2 then 'a_byron' when 3 then 'john' else concat('ann-', c_custkey) end")
    df = customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), u.alias("u"))
    return df.withColumn("name", S.name_from_email(F.concat("u", F.lit("@x.com"))))


@query(f"""select id, d, case when d like '%.edu%' then 'Nation ' || regexp_extract(d, '-([0-9]+)', 1) || ' University' else 'Nation ' || regexp_extract(d, '-([0-9]+)', 1) end as company from (select id, split_part(email, '@', 2) as d from ({CONTACTS}))""")
def company_from_domain(spark, sf_dir):
    df = contacts(spark, sf_dir).select("id", S.domain(F.col("email")).alias("d"))
    return df.withColumn("company", S.company_from_domain(F.col("d")))


@query("""select page_id, case when regexp_matches(h, 'university|college|\\.edu') then h else 'Unknown' end as institution from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as h from pages)""")
def institution_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.institution(F.col("url"), F.lit("x.com")).alias("institution"))


@query(f"""select id, case c when 'john o''neil' then 'John O''Neil' when 'mcdonald ANNA' then 'McDonald Anna' when 'dr. ada byron phd' then 'Dr. Ada Byron Phd' end as valid from (select id, regexp_replace(name, '\\s+', ' ', 'g') as c from ({CONTACTS}))""")
def validate_name(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", S.valid_name(F.col("name")).alias("valid"))


@query(f"select id, case when length(regexp_replace(phone, '[^0-9]', '', 'g')) between 7 and 15 then phone end as valid from ({CONTACTS})")
def validate_phone(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", S.valid_phone(F.col("phone")).alias("valid"))


@query(f"select id, case title when 'director OF research' then 'Director of Research' when 'senior engineer' then 'Senior Engineer' end as valid from ({CONTACTS})")
def validate_title(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", S.valid_title(F.col("title")).alias("valid"))


_SQL_COMPANY = "case when company = 'acme llc' then 'Acme LLC' when company = 'University Of Ghent' then 'University of Ghent' when company = 'Unknown' then company when company is not null then 'Company ' || split_part(company, ' ', 2) || ' Inc.' end"


@query(f"select id, {_SQL_COMPANY} as valid from ({CONTACTS})")
def validate_company(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", S.valid_company(F.col("company")).alias("valid"))


_VALIDATED = f"""(select *, least(1.0, (cast(0.3 as double) + case when vn is not null then cast(0.2 as double) else 0 end + case when vp is not null then cast(0.2 as double) else 0 end + case when vt is not null then cast(0.15 as double) else 0 end + case when vc is not null then cast(0.15 as double) else 0 end) * confidence) as validation_score from (
select id, email, confidence, extraction_method, source_url, name, phone, title, company,
 case when name = 'john o''neil' then 'John O''Neil' when name like 'mcdonald%' then 'McDonald Anna' when name like 'dr.%' then 'Dr. Ada Byron Phd' end as vn,
 case when length(regexp_replace(phone, '[^0-9]', '', 'g')) between 7 and 15 then phone end as vp,
 case title when 'director OF research' then 'Director of Research' when 'senior engineer' then 'Senior Engineer' end as vt,
 {_SQL_COMPANY} as vc from ({CONTACTS})))"""
_FIELDS = "id, email, coalesce(vn, nullif(name, '')) as name, coalesce(vp, nullif(phone, '')) as phone, coalesce(vt, nullif(title, '')) as title, coalesce(vc, nullif(company, '')) as company, confidence, extraction_method, source_url, validation_score"


@query(f"select {_FIELDS} from {_VALIDATED}")
def contact_validate(spark, sf_dir):
    """Normalised contacts with their scores."""
    return C.with_validated(contacts(spark, sf_dir)).select("id", "email", "name", "phone", "title", "company", "confidence", "extraction_method", "source_url", "validation_score")


@query(f"select {_FIELDS} from {_VALIDATED} qualify row_number() over (partition by email order by validation_score desc, id) = 1")
def contact_dedup(spark, sf_dir):
    return C.deduplicate(contact_validate(spark, sf_dir), order="id")


_FILLED = " + ".join(f"case when trim({c}) <> '' then 1 else 0 end" for c in ("name", "title", "company", "phone"))


@query(f"select id, email, source_url, name, extraction_method from ({CONTACTS}) qualify row_number() over (partition by source_url, lower(email) order by {_FILLED} desc, id) = 1")
def page_dedup(spark, sf_dir):
    return C.best_per_page(contacts(spark, sf_dir), "source_url", "id").select("id", "email", "source_url", "name", "extraction_method")


@query(f"select 'Extraction Method' as category, extraction_method as type, count(*) as count, printf('%.1f%%', count(*) * 100.0 / (select count(*) from ({CONTACTS}))) as percentage from ({CONTACTS}) group by extraction_method")
def summary_by_method(spark, sf_dir):
    return C.summary_by_method(contacts(spark, sf_dir))


@query(f"select 'Top Companies' as category, company as type, n as count, printf('%.1f%%', n * 100.0 / (select count(*) from ({CONTACTS}))) as percentage from (select company, count(*) as n, min(id) as o from ({CONTACTS}) where company <> 'Unknown' and company <> '' group by company order by n desc, o limit 10)")
def summary_top_companies(spark, sf_dir):
    return C.summary_top_companies(contacts(spark, sf_dir), "id")


_SHARE = "printf('%d (%.1f%%)', count(*) filter (where {c} <> ''), count(*) filter (where {c} <> '') * 100.0 / count(*))"


@query("select count(*) as total_contacts, " + ", ".join(f"{_SHARE.format(c=c)} as {n}" for c, n in (("name", "with_names"), ("phone", "with_phone_numbers"), ("title", "with_job_titles"), ("company", "with_companies"))) + f", printf('%.3f', sum(confidence) / count(*)) as average_confidence, printf('%.3f', sum(validation_score) / count(*)) as average_validation_score from (select {_FIELDS} from {_VALIDATED})")
def contact_statistics(spark, sf_dir):
    return C.statistics(contact_validate(spark, sf_dir))


@query(f"select (select count(*) from ({CONTACTS})) as total, count(*) as valid, round(avg(validation_score), 9) as mean_score, " + ", ".join(f"count(*) filter (where {c} <> '') as with_{c}" for c in ("name", "phone", "title", "company")) + f", cast(0 as bigint) as rejected, cast(0 as double) as rejection_rate from (select {_FIELDS} from {_VALIDATED})")
def validation_stats(spark, sf_dir):
    out = C.validation_stats(contacts(spark, sf_dir), contact_validate(spark, sf_dir))
    return out.withColumn("mean_score", F.round("mean_score", 9))


@query("select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as text from pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.strip_tags(F.col("html")).alias("text"))


@query("select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') as text from pages")
def clean_text(spark, sf_dir):
    """Text without tags, white space collapsed."""
    return table(spark, sf_dir, "pages").select("page_id", S.squeeze(F.regexp_replace("html", "<[^>]+>", "")).alias("text"))


@query("select id, r as rule, 'user' || id || '@host' || (id % 7) || '.com' as email from (select c_custkey as id, cast(c_custkey % 4 as int) as r from customer)")
def deobfuscate(spark, sf_dir):
    """Hidden addresses in made-up sentences, with the rule that found them."""
    text = F.expr("concat('write user', id, case id % 4 when 0 then '@' when 1 then ' [at] ' when 2 then '(AT)' else ' at ' end, 'host', id % 7, case id % 4 when 0 then '.' when 1 then ' [dot] ' when 2 then '(dot)' else ' dot ' end, 'com')")
    df = customers(spark, sf_dir).selectExpr("c_custkey as id").withColumn("t", text)
    return C.deobfuscate(df, "t", "id")


@query("select id, case id % 4 when 0 then 'linkedin' when 1 then 'github' when 2 then 'youtube' else 'tiktok' end as platform, case id % 4 when 0 then 'https://www.linkedin.com/in/u-' || id when 1 then 'http://GitHub.com/u' || id || '/x' when 2 then 'https://youtube.com/channel/u' || id else 'https://tiktok.com/@u.' || id end as url, case id % 4 when 0 then 'u-' || id when 3 then 'u.' || id else 'u' || id end as username from (select c_custkey as id from customer)")
def social_profiles(spark, sf_dir):
    url = F.expr("case id % 4 when 0 then concat('https://www.linkedin.com/in/u-', id) when 1 then concat('http://GitHub.com/u', id, '/x') when 2 then concat('https://youtube.com/channel/u', id) else concat('https://tiktok.com/@u.', id) end")
    return C.social_profiles(customers(spark, sf_dir).selectExpr("c_custkey as id").withColumn("u", url), "u", "id")


@query("""select id, url, id % 4 < 3 and id % 5 = 0 and not (id % 3 = 0) and (id % 2 = 0 or id % 200 <= 100) as ok from (select c_custkey as id, 'http://' || case when c_custkey % 5 = 0 then 'a.com' else 'b.com' end || case when c_custkey % 3 = 0 then '/x.PDF' else '/x' end || case when c_custkey % 2 = 1 then '?page=' || (c_custkey % 200) else '' end as url from customer)""")
def url_filter(spark, sf_dir):
    """Links that a crawl of one host would follow."""
    url = F.expr("concat('http://', if(id % 5 = 0, 'a.com', 'b.com'), if(id % 3 = 0, '/x.PDF', '/x'), if(id % 2 = 1, concat('?page=', id % 200), ''))")
    df = customers(spark, sf_dir).selectExpr("c_custkey as id").withColumn("url", url)
    return df.withColumn("ok", S.may_crawl(F.col("url"), F.lit("a.com"), F.col("id") % 4))


@query("select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, count(*) as n from pages group by 1")
def url_host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.try_parse_url("url", F.lit("AUTHORITY")).alias("host")).agg(F.count("*").alias("n"))


@query(f"select email, coalesce(name, '') as name, coalesce(title, '') as title, coalesce(company, '') as company, coalesce(phone, '') as phone, source_url, extraction_method, confidence, validation_score, '' as context from (select {_FIELDS} from {_VALIDATED})")
def export_clean(spark, sf_dir):
    """Rows as the CSV export writes them."""
    return C.export_rows(contact_validate(spark, sf_dir).withColumn("context", F.lit(None).cast("string")))


@query(f"select id, phone, case when length(regexp_replace(phone, '[^0-9+]', '', 'g')) = 10 then '(555) 123-4567' when phone = '+15551234567' then '+1 (555) 123-4567' end as clean, 'nation-' || regexp_extract(email, 'nation-([0-9]+)', 1) || regexp_extract(email, '(\\.[a-z]+)$', 1) as domain from ({CONTACTS})")
def clean_phone(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", "phone", S.clean_phone(F.col("phone")).alias("clean"), S.email_domain(F.col("email")).alias("domain"))


@query(f"select id, case when name = 'john o''neil' then 'John O''neil' when name like 'mc%' then 'Mcdonald Anna' when name = 'Click here' then 'Click Here' when name like 'dr.%' then 'Ada Byron' end as name, case when company = 'acme llc' then 'Acme LLC' when company = 'University Of Ghent' then company when company = 'Unknown' then company when company is not null then 'Company ' || split_part(company, ' ', 2) || ' Inc' end as company from ({CONTACTS})")
def clean_names(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", S.clean_name(F.col("name")).alias("name"), S.clean_company(F.col("company")).alias("company"))


def _lead(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} as {k}" for k, v in columns.items())


@query(f"select id, email, " + _lead({"first_name": "nullif(split_part(trim(coalesce(name, '')), ' ', 1), '')", "last_name": "case when regexp_matches(trim(coalesce(name, '')), ' ') then regexp_extract(trim(name), '^[^ ]+ +(.*)$', 1) else 'Unknown' end", "source": "'Web Scraping'"}) + f" from ({CONTACTS})")
def crm_lead(spark, sf_dir):
    lead = C.crm_leads(contacts(spark, sf_dir).withColumn("email", F.concat_ws("|", "id", "email")))
    parts = F.split("email", r"\|")
    return lead.select(parts[0].cast("long").alias("id"), parts[1].alias("email"), F.col("lead")["FirstName"].alias("first_name"), F.col("lead")["LastName"].alias("last_name"), F.col("lead")["LeadSource"].alias("source"))


@query(f"select id, email, " + _lead({"firstname": "nullif(split_part(trim(coalesce(name, '')), ' ', 1), '')", "lastname": "case when regexp_matches(trim(coalesce(name, '')), ' ') then regexp_extract(trim(name), '^[^ ]+ +(.*)$', 1) end", "stage": "'lead'"}) + f" from ({CONTACTS})")
def crm_contact(spark, sf_dir):
    row = C.crm_contacts(contacts(spark, sf_dir).withColumn("email", F.concat_ws("|", "id", "email")))
    parts = F.split("email", r"\|")
    return row.select(parts[0].cast("long").alias("id"), parts[1].alias("email"), F.col("properties")["firstname"].alias("firstname"), F.col("properties")["lastname"].alias("lastname"), F.col("properties")["lifecyclestage"].alias("stage"))


@query("""with recursive e as (select distinct l_orderkey % 997 as src, l_partkey % 997 as dst from lineitem where l_linenumber = 1), b(node, depth) as (select 1, 0 union select dst, depth + 1 from b join e on src = node where depth < 2) select cast(node as bigint) as node, cast(min(depth) as int) as depth from b group by node""")
def crawl_levels(spark, sf_dir):
    """Breadth-first levels over links made of line items."""
    edges = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").selectExpr("l_orderkey % 997 as src", "l_partkey % 997 as dst").distinct()
    seeds = spark.range(1, 2).select(F.col("id").alias("node"))
    return C.crawl_levels(edges, seeds, 3)


@query("""with recursive e as (select distinct l_orderkey as src, l_partkey as dst from lineitem), b(node, depth) as (select min(src), 0 from e union select dst, depth + 1 from b join e on src = node where depth < 2) select cast(node as bigint) as node, cast(min(depth) as int) as depth from b where node is not null group by node""")
def crawl_levels_whole(spark, sf_dir):
    """Breadth-first levels over links made of every line item, from the first order."""
    edges = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as src", "l_partkey as dst").distinct()
    seeds = edges.agg(F.min("src").alias("node")).filter("node is not null")
    return C.crawl_levels(edges, seeds, 3)


@query()
def page_contacts(spark, sf_dir):
    """Stored pages to scored contacts, one per page and address."""
    return pages_plan.page_contacts(table(spark, sf_dir, "pages"))


@query()
def site_contacts(spark, sf_dir):
    """Stored pages to contacts, one per site and address."""
    return pages_plan.site_contacts(table(spark, sf_dir, "pages")).drop("context")


@query("""select page_id, url as src, cast(ord - 1 as int) as ord, regexp_extract(url, '^[a-z]+://[^/?#]+') || replace(regexp_replace(href, '#.*$', ''), '&amp;', '&') as dst
from (select page_id, url, generate_subscripts(found, 1) as ord, unnest(found) as href from (select page_id, url, regexp_extract_all(html, '<a [^>]*href="(/[^"]*)"', 1) as found from pages))""")
def page_links(spark, sf_dir):
    """Absolute links of all pages."""
    return pages_plan.link_edges(table(spark, sf_dir, "pages"))

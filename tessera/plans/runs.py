"""Queries over whole runs: crawl, export rows, counters; and rules for running text on the documents themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import wording as W
from tessera.operators import contacts as C
from tessera.operators import crawl as R
from tessera.plans import pages as pages_plan
from tessera.plans.catalog import _FIELDS, _VALIDATED, CONTACTS, contacts, contact_validate, customers, query, table
from tessera.settings import Settings
from tessera.sources import exports as E
from tessera.sources import html as H

@query("""with recursive e as (select distinct l_orderkey as s, l_partkey as d, 's' || (l_orderkey % 3) || '.com' as hs, 's' || (l_partkey % 3) || '.com' as hd from lineitem),
b(site, node, depth) as (select distinct arg_min(hs, s), min(s), 0 from e group by s % 97 union select site, d, depth + 1 from b join e on e.s = b.node where depth < 3 and hd = site and d % 5 <> 0 and site <> 's2.com')
select site, 'http://' || site || '/' || node as url, cast(min(depth) as int) as depth from b group by site, node""")
def crawl_sites(spark, sf_dir):
    """Pages that crawls of three sites from 97 starts visit over links made of every line item; one site is excluded beyond its starts."""
    pairs = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as s", "l_partkey as d").distinct()
    url = lambda k, end="''": f"concat('http://s', {k} % 3, '.com/', {k}, {end})"
    pdf = "if(d % 5 = 0, '.pdf', '')"
    links = pairs.selectExpr(f"{url('s')} as src", f"{url('d', pdf)} as dst")
    seeds = pairs.groupBy(F.expr("s % 97")).agg(F.min("s").alias("s")).selectExpr(f"{url('s')} as url")
    return R.crawl(links, seeds, Settings(max_depth=4, max_pages=1 << 30, excluded_domains=("s2.com",)))


@query("""select id, url, regexp_matches(url, '^http://(a|b)\\.com/') and not url like 'http://b.com/%' and not (id % 3 = 0) as ok from (select c_custkey as id, 'http://' || case c_custkey % 4 when 0 then 'a.com' when 1 then 'b.com' else 'c.com' end || '/p' || c_custkey || case when c_custkey % 3 = 0 then '.zip' else '' end as url from customer)""")
def url_filter_lists(spark, sf_dir):
    """Links of any host that lists of allowed and excluded hosts let pass."""
    df = customers(spark, sf_dir).selectExpr("c_custkey as id", "concat('http://', case c_custkey % 4 when 0 then 'a.com' when 1 then 'b.com' else 'c.com' end, '/p', c_custkey, if(c_custkey % 3 = 0, '.zip', '')) as url")
    own = F.try_parse_url("url", F.lit("AUTHORITY"))
    return df.withColumn("ok", S.may_crawl(F.col("url"), own, F.lit(0), 3, ("a.com", "b.com"), ("b.com",)))


@query(f"select email, coalesce(name, '') as name, coalesce(title, '') as title, coalesce(company, '') as company, coalesce(phone, '') as phone, source_url, extraction_method, confidence, validation_score, '' as context from (select {_FIELDS} from {_VALIDATED} qualify row_number() over (partition by email order by validation_score desc, id) = 1)")
def process_results(spark, sf_dir):
    """Validated, one contact an address, as exported."""
    return pages_plan.process_results(contacts(spark, sf_dir).withColumn("context", F.lit(None).cast("string")), "id")


@query(f"select email, coalesce(name, '') as name, coalesce(title, '') as title, coalesce(company, '') as company, coalesce(phone, '') as phone, source_url, extraction_method, round_even(confidence, 3) as confidence, round_even(validation_score, 3) as validation_score, id from (select {_FIELDS} from {_VALIDATED})")
def workbook_rows(spark, sf_dir):
    """Rows of the workbook's first sheet."""
    return E.sheet_rows(contact_validate(spark, sf_dir))


@query(f"select id, email, split_part(email, '@', 2) = 'mailinator.com' as disposable from (select id, case when id % 5 = 0 then split_part(email, '@', 1) || '@mailinator.com' when id % 5 = 1 then split_part(email, '@', 1) || '@mailinator.com.org' else email end as email from ({CONTACTS}))")
def disposable_flag(spark, sf_dir):
    """Contacts with whether their address is a throw-away one."""
    user = "split_part(email, '@', 1)"
    df = contacts(spark, sf_dir).selectExpr("id", f"case when id % 5 = 0 then concat({user}, '@mailinator.com') when id % 5 = 1 then concat({user}, '@mailinator.com.org') else email end as email")
    return df.withColumn("disposable", W.is_disposable(F.col("email")))


_PAGE_RUNS = "o_orderkey % 3 as emails, o_orderkey % 2 as contacts, o_orderstatus = 'F' as failed"


@query(f"select count(*) as pages_crawled, cast(sum(emails) as bigint) as emails_found, cast(sum(contacts) as bigint) as contacts_found, count(*) filter (where failed) as failed_pages, round(cast(count(*) filter (where not failed) as double) / count(*) * 100, 6) as success_rate from (select {_PAGE_RUNS} from orders)")
def run_counters(spark, sf_dir):
    """What a run over made-up pages counted."""
    out = R.run_counters(table(spark, sf_dir, "orders").selectExpr(*_PAGE_RUNS.split(", ")))
    return out.withColumn("success_rate", F.round("success_rate", 6))


@query(f"select count(*) as sites, count(*) filter (where ok) as succeeded from (select o_custkey, bool_or(not failed) as ok from (select o_custkey, {_PAGE_RUNS} from orders) group by o_custkey)")
def batch_summary(spark, sf_dir):
    """Of how many sites at least one page could be read."""
    return R.batch_summary(table(spark, sf_dir, "orders").selectExpr("o_custkey", *_PAGE_RUNS.split(", ")), F.col("o_custkey"))


_CUE_SQL = ", ".join("(" + " or ".join(f"regexp_matches(t, '{p}')" for p in ps) + f") as {kind}" for kind, ps in W.CUES.items())


@query(f"select doc_id, {_CUE_SQL} from (select doc_id, coalesce(text, '') as t from documents)")
def context_cues(spark, sf_dir):
    """Which documents have words that tell of contacts, roles, companies or places."""
    return table(spark, sf_dir, "documents").select("doc_id", *[W.has_cue(F.col("text"), k).alias(k) for k in W.CUES])


_LENGTHS = lambda patterns, group: " + ".join(f"len(regexp_extract_all(t, '{p}', {group}))" for p in patterns)


@query(f"select doc_id, cast({_LENGTHS(W.JOB_TITLES, 0)} as int) as titles, cast({_LENGTHS(W.HIDDEN_PHONES, 0)} as int) as phones, cast({_LENGTHS(W.COMPANY_NAMES, 1)} as int) as companies from (select doc_id, regexp_replace(coalesce(text, ''), '[\u00c0-\u024f]', '_', 'g') as t from documents)")
def text_finds(spark, sf_dir):
    """How many titles, phone numbers and company names the wide patterns find in each document."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(W.job_titles(text)).alias("titles"), F.size(W.hidden_phones(text)).alias("phones"), F.size(W.company_names(text)).alias("companies"))


@query("""select c_custkey as id, case c_custkey % 4 when 0 then 'Director' when 1 then 'Analyst' when 2 then '' else 'Manager' end as title, case c_custkey % 4 when 0 then '555-' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || '-1234' end as phone from customer""")
def title_windows(spark, sf_dir):
    """The title within three tokens of a name, and a phone number with other marks."""
    text = "case c_custkey % 4 when 0 then concat('the director, Ada Byron; tel 555.', lpad(cast(c_custkey % 1000 as string), 3, '0'), '.1234') when 1 then 'Ada Byron is our ANALYST' when 2 then 'manager of a big house near Ada Byron' else 'Ada Byron, senior manager and director' end"
    df = customers(spark, sf_dir).selectExpr("c_custkey as id", f"{text} as t")
    return df.select("id", W.title_in_window(F.col("t"), F.lit("Ada Byron")).alias("title"), F.get(W.hidden_phones(F.col("t")), F.lit(0)).alias("phone"))


@query("select id, rule, email from (select c_custkey as id, unnest([cast(0 as int), cast(6 as int)]) as rule, 'u' || c_custkey as u from customer) join (select 0 as r, 'cs.mit' as h union all select 6, 'cs.mit.edu') on r = rule cross join (select '' as x) , lateral (select u || '@' || h as email)")
def deobfuscate_long_domains(spark, sf_dir):
    """Hidden addresses whose domain has three parts."""
    df = customers(spark, sf_dir).selectExpr("c_custkey as id", "concat('to u', c_custkey, ' @ cs . mit . edu') as t")
    return C.deobfuscate(df, "t", "id")


@query("""select doc_id, pattern, email, cast(confidence as double) as confidence from (select doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '(?i)\\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})\\b', 1))) as email, 'basic' as pattern, 0.9 as confidence from documents
 union all select doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '(?i)([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1))), 'relaxed', 0.8 from documents
 union all select doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '(?i)(?:email|e-mail|mail|contact)?\\s*:?\\s*([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})', 1))), 'with_context', 0.8 from documents
 union all select doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '(?i)["''(]([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})["'')]', 1))), 'quoted', 0.8 from documents)
 where length(email) between 5 and 254 and not regexp_matches(email, '[|]')""")
def standard_emails(spark, sf_dir):
    """Addresses in documents by each of the four standard patterns."""
    return C.standard_emails(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""select doc_id, case when length(t) <= 200 then t when strpos(reverse(substring(t, 1, 197)), ' ') > 0 and 197 - strpos(reverse(substring(t, 1, 197)), ' ') > 140 then substring(t, 1, 197 - strpos(reverse(substring(t, 1, 197)), ' ')) || '...' else substring(t, 1, 197) || '...' end as short,
 trim(replace(regexp_replace(regexp_replace(coalesce(t, ''), ' +', ' ', 'g'), '\n+', chr(10), 'g'), chr(9), ' '), ' ') as single, regexp_matches(coalesce(u, ''), '^https?://[^/?#]+') as is_url from (select doc_id, text as t, case when doc_id % 3 = 0 then 'http://h' || doc_id || '.com/x' when doc_id % 3 = 1 then 'ftp://h.com/' else source end as u from documents)""")
def text_forms(spark, sf_dir):
    """Documents cut short, with single blanks, and whether a text is a web address."""
    u = F.expr("case when doc_id % 3 = 0 then concat('http://h', doc_id, '.com/x') when doc_id % 3 = 1 then 'ftp://h.com/' else source end")
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate(F.col("text")).alias("short"), S.single_spaces(F.col("text")).alias("single"), S.is_url(u).alias("is_url"))


@query(r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g'), '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '<[^>]+>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s]+', ' ', 'g'), ' ') as text from pages""")
def page_text(spark, sf_dir):
    """What pages say, without scripts and styles."""
    return H.read_text(table(spark, sf_dir, "pages"))

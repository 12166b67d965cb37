"""Queries of the text rules, the markup readers and the robots filter; they join the catalogue's on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import texts as T
from tessera.operators import contacts as C
from tessera.operators import matcher as M
from tessera.operators import robots as R
from tessera.plans.catalog import _SCAN, _SQL_EMAIL, P, customers, query, table
from tessera.sources import people as X

_NAMES = "case c_custkey % 9 when 0 then 'Ada Byron' when 1 then 'ada byron' when 2 then 'Info Desk' when 3 then 'Ada' when 4 then 'Ann Lee Stone Roe' when 5 then 'University Of Ghent' when 6 then 'Team 1234567 X' when 7 then 'Dr Bob Stone' end"
_EMAILS = "case c_custkey % 4 when 0 then 'ada.byron@x.com' when 1 then 'als@x.com' when 2 then 'stone@y.org' else 'ab@x.com' end"


def _customers(spark, sf_dir, **columns: str):
    return customers(spark, sf_dir).selectExpr("c_custkey as id", *[f"{v} as {k}" for k, v in columns.items()])


@query(f"""with e as ({_SCAN.format(key="doc_id", text="text", table="documents", p=P.EMAIL, valid=_SQL_EMAIL)}),
s as (select doc_id, ord, email, text as t, instr(lower(text), email) - 1 as p, regexp_split_to_array(text, '[.!?]+') as ss from e join documents using (doc_id)),
u as (select doc_id, ord, p, unnest(ss) as x, generate_subscripts(ss, 1) as i from s),
w as (select *, sum(length(x) + 1) over (partition by doc_id, ord order by i) - length(x) - 1 as b from u),
f as (select doc_id, ord, min(i) as i from w where p between b and b + length(x) group by all)
select s.doc_id, s.ord, s.email, case when i is null then substring(t, greatest(p - 100, 0) + 1, p + 100 - greatest(p - 100, 0))
 else array_to_string(list_filter(list_transform(ss[greatest(i - 2, 1):i + 2], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '. ') end as sentences
from s left join f on s.doc_id = f.doc_id and s.ord = f.ord""")
def sentences_around_email(spark, sf_dir):
    """The sentences round each address of the documents."""
    docs = table(spark, sf_dir, "documents")
    found = C.scan_emails(docs.select("doc_id", "text", F.col("text").alias("whole")), "text", "doc_id", "whole")
    return found.select("doc_id", "ord", "email", T.sentences_around(F.col("whole"), F.col("email")).alias("sentences"))


@query("""select page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') as paragraphs from pages""")
def text_between_markers(spark, sf_dir):
    """What stands between paragraph marks of the pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.between(F.col("html"), "<p>", "</p>"), "|").alias("paragraphs"))


@query(f"""select doc_id, coalesce(nullif(array_to_string(regexp_extract_all(coalesce(text, ''), '{P.EMAIL}'), '|'), ''), '-') as emails,
 coalesce(nullif(array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]{{3}}-[0-9]{{3,4}}'), '|'), ''), '-') as numbers from documents""")
def structured_data(spark, sf_dir):
    """All matches of named patterns in the documents."""
    found = T.structured(F.col("text"), {"emails": P.EMAIL, "numbers": "[0-9]{3}-[0-9]{3,4}"})
    values = [F.coalesce(F.array_join(F.try_element_at(found, F.lit(k)), "|"), F.lit("-")).alias(k) for k in ("emails", "numbers")]
    return table(spark, sf_dir, "documents").select("doc_id", *values)


@query("""select c_custkey as id, case c_custkey % 4 when 0 then 'Director of Research ' || c_custkey when 1 then 'Senior Engineer' when 2 then 'Of Counsel' end as title from customer""")
def clean_title(spark, sf_dir):
    df = _customers(spark, sf_dir, t="case c_custkey % 4 when 0 then concat('Title:  director OF  research, ', c_custkey) when 1 then 'senior engineer.' when 2 then 'job: of COUNSEL' else ' ' end")
    return df.select("id", T.clean_title(F.col("t")).alias("title"))


@query(f"""select id, coalesce(length(n) between 2 and 50 and length(regexp_replace(n, '[^\\pL]', '', 'g')) / length(n) >= 0.7 and regexp_matches(n, '^\\p{{Lu}}') and not regexp_matches(lower(n), '\\b({"|".join(T.NOT_LIKELY)})\\b'), false) as likely,
 coalesce(regexp_matches(n, '^(\\p{{Lu}}\\pL+ ){{1,3}}\\p{{Lu}}\\pL+$') and not regexp_matches(lower(n), '{"|".join(T.NOT_CONFIDENT)}'), false) as confident,
 coalesce(regexp_matches(n, '^([A-Z][A-Za-z.'']* ){{1,3}}[A-Z][A-Za-z.'']*$'), false) as looks from (select c_custkey as id, {_NAMES} as n from customer)""")
def name_rules(spark, sf_dir):
    """Which strings pass for names under the three rules."""
    n = F.col("n")
    return _customers(spark, sf_dir, n=_NAMES).select("id", T.likely_person(n).alias("likely"), T.confident_name(n).alias("confident"), S.looks_like_name(n).alias("looks"))


@query(f"""select id, coalesce(lower(trim(v)) in ({", ".join(f"'{t}'" for t in T.CONFIDENT_TITLES)}), false) as title_ok,
 coalesce(length(trim(v)) >= 3 and regexp_matches(lower(v), '{"|".join(T.ORGANISATIONS)}'), false) as company_ok,
 coalesce(length(trim(v)) >= 5 and not regexp_matches(lower(v), '{"|".join(T.NOT_ORGANISATIONS)}'), false) as organization_ok
from (select c_custkey as id, case c_custkey % 6 when 0 then ' Prof. ' when 1 then 'Acme Inc' when 2 then 'Email Company' when 3 then 'Dean' when 4 then 'College ' || c_custkey end as v from customer)""")
def title_and_company_rules(spark, sf_dir):
    df = _customers(spark, sf_dir, v="case c_custkey % 6 when 0 then ' Prof. ' when 1 then 'Acme Inc' when 2 then 'Email Company' when 3 then 'Dean' when 4 then concat('College ', c_custkey) end")
    v = F.col("v")
    return df.select("id", T.confident_title(v).alias("title_ok"), T.confident_company(v).alias("company_ok"), T.valid_organization(v).alias("organization_ok"))


@query(f"""with c as (select c_custkey as id, {_NAMES} as n, {_EMAILS} as e from customer), u as (select *, split_part(e, '@', 1) as u, string_split(lower(n), ' ') as w from c),
x as (select *, array_to_string(list_transform(w, lambda a: a[1]), '') as ini, replace(lower(n), ' ', '') as j from u)
select id, coalesce(len(w) >= 2 and (len(list_filter(w, lambda a: length(a) > 2 and contains(u, a))) > 0 or contains(u, ini)), false) as fits,
 coalesce(regexp_matches(n, '^(\\p{{Lu}}\\p{{Ll}}+ )+\\p{{Lu}}\\p{{Ll}}+$') and len(list_filter(w, lambda a: length(a) >= 3 and contains(u, a))) > 0, false) as fits_strictly,
 case when contains(u, j) or contains(j, u) then cast(1 as double) else 0 end + cast(0.5 as double) * len(list_filter(w, lambda a: length(a) > 2 and contains(u, a))) + case when len(w) >= 2 and contains(u, ini) then cast(0.3 as double) else 0 end as score from x""")
def name_fit(spark, sf_dir):
    """How well names fit addresses."""
    n, e = F.col("n"), F.col("e")
    return _customers(spark, sf_dir, n=_NAMES, e=_EMAILS).select("id", T.name_fits(n, e).alias("fits"), T.name_fits_strictly(n, e).alias("fits_strictly"), T.name_score(n, e).alias("score"))


@query("""select c_custkey as id, case c_custkey % 3 when 0 then 'Ada Byron' when 1 then 'Bob Stone' else 'Zoe Zed' end as name, case c_custkey % 2 when 0 then 'Ghent University' else 'Acme Inc' end as organization, case c_custkey % 2 when 0 then 'Ada Byron' else '' end as quiet from customer""")
def best_candidates(spark, sf_dir):
    """The best of several names for an address, the best organisation, and a name without noise."""
    df = _customers(
        spark,
        sf_dir,
        names="array('Zoe Zed', 'Ada Byron', 'Bob Stone')",
        e="case c_custkey % 3 when 0 then 'a.byron@x.com' when 1 then 'bstone@x.com' else 'q7@x.com' end",
        orgs="case c_custkey % 2 when 0 then array('Acme Inc', 'Ghent University') else array('Acme Inc') end",
        noisy="case c_custkey % 2 when 0 then 'Dr Ada B Byron Department' else 'Faculty Ada' end",
    )
    return df.select("id", T.best_name(F.col("names"), F.col("e")).alias("name"), T.best_organization(F.col("orgs")).alias("organization"), T.without_noise(F.col("noisy")).alias("quiet"))


@query("""select c_custkey as id, case c_custkey % 4 when 0 then 'Professor' when 1 then 'dean' else '' end as strict, case c_custkey % 4 when 0 then 'Professor' when 2 then 'Senior Clerk' else '' end as loose,
 case c_custkey % 4 when 0 then '(617) 555-0123' when 1 then '+90 (312) 555 12 34 / 4567' when 2 then '617.555.0123' else '' end as phone from customer""")
def strict_fields(spark, sf_dir):
    """Titles and complete phone numbers in sentences."""
    t = F.col("t")
    df = _customers(spark, sf_dir, t="case c_custkey % 4 when 0 then 'Associate Professor Byron (617) 555-0123' when 1 then 'the dean, +90 (312) 555 12 34 / 4567' when 2 then 'Senior Clerk 617.555.0123' else 'call 555-0123' end")
    return df.select("id", T.strict_title(t).alias("strict"), T.loose_title(t).alias("loose"), T.complete_phone(t).alias("phone"))


@query("""select c_custkey as id, case c_custkey % 3 when 0 then 'a' || c_custkey || '@x.com' else '' end as email, 'contacts_host' || c_custkey || '_example_com:80_20240102_030405' as file from customer""")
def clean_email_and_file_name(spark, sf_dir):
    df = _customers(spark, sf_dir, e="case c_custkey % 3 when 0 then concat(' A', c_custkey, '@X.com ') when 1 then 'a@b' end", u="concat('http://www.host', c_custkey, '.example.com:80/x')")
    return df.select("id", T.clean_email(F.col("e")).alias("email"), T.export_name(F.col("u"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("file"))


@query("""select page_id, url, not (length(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) % 2 = 0 and regexp_matches(url, '^[a-z]+://[^/?#]+/fr')) as may_fetch from pages""")
def robots_filter(spark, sf_dir):
    """Which pages a crawler may fetch, half of the hosts closing one folder."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(F.try_parse_url("url", F.lit("AUTHORITY")).alias("host")).distinct().filter("length(host) % 2 = 0")
    return R.with_robots(pages, hosts.withColumn("rules", F.lit("User-agent: *\nDisallow: /fr")))


_MARKED = """case c_custkey % 3
 when 0 then concat('<div itemscope itemtype="http://schema.org/Person"><span itemprop="name">Ada Byron</span><b>(555) 123-4567</b><i itemprop="jobTitle">Head</i><i itemprop="worksFor">Acme ', c_custkey, '</i><p>a', c_custkey, '@x.org</p></div>')
 when 1 then concat('<div class="vcard"><h2 class="fn">Bob Stone</h2><i class="role">Clerk</i><i class="org">Org ', c_custkey, '</i>b', c_custkey, '@y.com</div>')
 else '<p>nobody</p>' end"""


def _html(spark, sf_dir, html: str):
    return customers(spark, sf_dir).selectExpr("c_custkey as page_id", f"{html} as html")


@query("""select c_custkey as page_id, 0 as ord, case c_custkey % 3 when 0 then 'a' || c_custkey || '@x.org' else 'b' || c_custkey || '@y.com' end as email, case c_custkey % 3 when 0 then 'Ada Byron' else 'Bob Stone' end as name,
 case c_custkey % 3 when 0 then 'Head' else 'Clerk' end as title, case c_custkey % 3 when 0 then '555-123-4567' end as phone, case c_custkey % 3 when 0 then 'Acme ' else 'Org ' end || c_custkey as company from customer where c_custkey % 3 < 2""")
def markup_fields(spark, sf_dir):
    """Fields from schema.org persons, cards and neighbours."""
    return X.read_markup_fields(_html(spark, sf_dir, _MARKED)).drop("error")


@query("""select c_custkey as page_id, 0 as ord, case c_custkey % 3 when 0 then 'ann@x' else 'bob@x' end || c_custkey || '.edu' as email, case c_custkey % 3 when 0 then 'Ann Lee' else 'Bob Stone' end as name, case c_custkey % 3 when 0 then 'Professor' else 'Dr.' end as title,
 case c_custkey % 3 when 0 then 'Ann Lee Professor ann@x' else 'Dr. Bob Stone bob@x' end || c_custkey || '.edu' as context from customer where c_custkey % 3 < 2""")
def staff_directory(spark, sf_dir):
    """Entries of staff lists."""
    rows = "case c_custkey % 3 when 0 then concat('<li><b>Ann Lee</b> Professor <i>ann@x', c_custkey, '.edu</i></li>') when 1 then concat('<li>Dr. Bob Stone bob@x', c_custkey, '.edu</li>') else '<li>none</li>' end"
    return X.read_staff(_html(spark, sf_dir, f"concat('<div class=\"staff-list\"><ul>', {rows}, '</ul></div>')")).drop("error")


@query("""select c_custkey as page_id, 0 as ord, case c_custkey % 3 when 0 then 'h' when 1 then 'hidden.user.number' else 's' end || c_custkey || '@z.com' as email, case c_custkey % 3 when 0 then 'css_hidden' when 1 then 'base64_decoded' else 'javascript' end as method,
 case c_custkey % 3 when 0 then cast(0.7 as double) when 1 then cast(0.8 as double) else cast(0.75 as double) end as confidence from customer""")
def hidden_emails(spark, sf_dir):
    """Addresses behind styles, base64 and scripts."""
    html = "case c_custkey % 3 when 0 then concat('<b style=\"display:none\">h', c_custkey, '@z.com</b>') when 1 then concat('<b>', base64(cast(concat('hidden.user.number', c_custkey, '@z.com') as binary)), '</b>') else concat('<script>x = ''s', c_custkey, ''' + ''@'' + ''z.com''</script>') end"
    return X.read_hidden(_html(spark, sf_dir, html)).drop("context", "error")


@query()
def matched_contacts(spark, sf_dir):
    """Every page's addresses with fields from the text near them, the markup, labels and the address."""
    found = X.read_hits_with_markup(table(spark, sf_dir, "pages")).filter("error is null")
    return M.match_contacts(found, markup="markup").drop("ord", "text", "markup", "context", "error").distinct()

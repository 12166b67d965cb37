"""Crawls, settings, exports and text rules on rows worked out by hand."""

import json
import random
import xml.etree.ElementTree as ET
import zipfile
from datetime import datetime

import duckdb
import pytest

from tessera.functions import wording as W
from tessera.operators import crawl, robots  # noqa: F401
from tessera.plans import catalog, pages, runs
from tessera.settings import Settings
from tessera.sources import exports, people
from tessera.sources import html as H

TABLES = ("customer", "nation", "orders", "lineitem", "documents", "pages")
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == runs.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_queries_give_the_rows_of_their_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    got, want = catalog.QUERIES[name](spark, data).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def plain_crawl(edges, starts, settings, closed=()):
    out = {}
    for site in {s.split("/")[2] for s in starts}:
        level = sorted(s for s in set(starts) if s.split("/")[2] == site)[: settings.max_pages]
        seen = dict.fromkeys(level, 0)
        for depth in range(1, settings.max_depth):
            found = {d for s, d in edges if s in level and d not in seen and d.split("/")[2] == site and not d.endswith(".pdf") and d not in closed}
            level = sorted(found)[: settings.max_pages - len(seen)]
            seen.update(dict.fromkeys(level, depth))
        out |= {(site, u): d for u, d in seen.items()}
    return out


@pytest.mark.parametrize("most", [1, 3, 7, 1000])
def test_crawl(spark, most):
    r = random.Random(most)
    urls = [f"http://h{i % 3}.com/{i}{'.pdf' if i % 7 == 0 else ''}" for i in range(60)]
    edges = [(r.choice(urls), r.choice(urls)) for _ in range(400)]
    closed = {u for u in urls if u.startswith("http://h1.com/1")}
    links = spark.createDataFrame(edges + edges[:5], "src string, dst string")
    seeds = spark.createDataFrame([(urls[i],) for i in (1, 3, 4, 3)], "url string")
    rules = spark.createDataFrame([("h1.com", "User-agent: *\nDisallow: /1")], "host string, rules string")
    starts = [urls[i] for i in (1, 3, 4)]
    for settings, own in ((Settings(max_depth=4, max_pages=most), closed), (Settings(max_depth=4, max_pages=most, ignore_robots_txt=True), ())):
        got = {(x.site, x.url): x.depth for x in crawl.crawl(links, seeds, settings, rules).collect()}
        assert got == plain_crawl(edges, starts, settings, own)


def test_settings(monkeypatch):
    with pytest.raises(ValueError, match="max_depth"):
        Settings(max_depth=0)
    with pytest.raises(ValueError, match="max_depth"):
        Settings(max_depth=21)
    with pytest.raises(ValueError, match="output_format"):
        Settings(output_format="xml")
    for k, v in (("MAX_PAGES", "7"), ("VALIDATE_EMAILS", "True"), ("EXCLUDED_DOMAINS", "a.com, b.com"), ("SALESFORCE_PASSWORD", "p"), ("OUTPUT_FORMAT", "json")):
        monkeypatch.setenv("TESSERA_" + k, v)
    s = Settings.from_env()
    assert (s.max_depth, s.max_pages, s.validate_emails, s.excluded_domains, s.output_format) == (3, 7, True, ("a.com", "b.com"), "json")
    assert "'salesforce_password': '***'" in str(s) and "'p'" not in str(s) and "'p'" not in repr(s)


CONTACTS = [
    ("a@x.com", "Ann", None, "Acme", "1", "http://x.com", "m", 0.12345, 0.0005, "line\nbreak", "more"),
    ("b@x.com", "None", "nan", "Acme", None, "http://x.com", "m", 0.9, 0.0015, None, None),
    ("c@x.com", "Cy", "é", "Unknown", "", None, None, None, 0.5, "", "x"),
]
SCHEMA = "email string, name string, title string, company string, phone string, source_url string, extraction_method string, confidence double, validation_score double, context string, extra string"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame(CONTACTS, SCHEMA)
    at = datetime(2024, 1, 2, 3, 4, 5)
    for kind in ("json", "excel", "csv"):
        path = exports.export_results(df, "http://www.x.com:80/p", Settings(output_format=kind, output_dir=str(tmp_path)), at)
        assert path.startswith(f"{tmp_path}/contacts_x_com:80_20240102_030405.")
        if kind == "json":
            found = json.load(open(path))
            assert found["metadata"]["total_contacts"] == 3 and found["metadata"]["export_timestamp"] == "2024-01-02T03:04:05"
            assert sorted((list(c.values()) for c in found["contacts"]), key=str) == sorted((list(c) for c in CONTACTS), key=str)
        if kind == "excel":
            book = zipfile.ZipFile(path)
            sheets = {}
            for i, name in enumerate(("Contacts", "Summary", "Statistics"), 1):
                root = ET.fromstring(book.read(f"xl/worksheets/sheet{i}.xml"))
                sheets[name] = [["".join(c.itertext()) for c in row] for row in root.iter() if row.tag.endswith("}row")]
            assert f'name="{"Statistics"}"' in book.read("xl/workbook.xml").decode()
            assert sheets["Contacts"][0][-1] == "extra" and ["b@x.com", "", "", "Acme", "", "http://x.com", "m", "0.9", "0.002", "", ""] in sheets["Contacts"]
            assert ["Top Companies", "Acme", "2", "66.7%"] in sheets["Summary"] and sheets["Statistics"][0][:2] == ["Total Contacts", "With Names"]
        if kind == "csv":
            assert spark.read.option("header", True).csv(path).count() == 3
    none = exports.export_results(df.filter("false"), "http://x.com", Settings(output_dir=str(tmp_path), output_file="none"), at)
    assert none == f"{tmp_path}/none.csv" and not (tmp_path / "none.csv").exists()
    empty = exports.export_results(df.filter("false"), "http://x.com", Settings(output_dir=str(tmp_path), output_file="none", output_format="excel"), at)
    assert zipfile.ZipFile(empty).namelist()
    with pytest.raises(ValueError, match="more contacts"):
        exports.write_document(df, str(tmp_path / "x.json"), Settings(), at, most=2)
    assert pages.process_results(df, "email", validate=False).count() == 3


def test_wide_patterns(spark):
    rows = [
        ("Jane Roe, Chief Technology Officer at Acme Inc. Call 555.123.4567 or 555 dash 123 dash 4567", "Jane Roe"),
        (None, None),
        ("we lead the team at \"Big Blue\"; 555-123.4567", ""),
        ("Senior manager Bob O'Neil", "Bob O'Neil"),
    ]
    from pyspark.sql import functions as F

    t = F.col("t")
    df = spark.createDataFrame(rows, "t string, n string")
    got = df.select(W.job_titles(t).alias("j"), W.hidden_phones(t).alias("p"), W.company_names(t).alias("c"), W.title_in_window(t, F.col("n")).alias("w"), *[W.has_cue(t, k).alias(k) for k in W.CUES]).collect()
    assert got[0].j == ["Chief Technology Officer"] and got[0].p == ["555-123-4567", "555-123-4567"] and "Acme" in " ".join(got[0].c) and got[0].w == "" and got[0].contact
    assert tuple(got[1]) == ([], [], [], "", False, False, False, False)
    assert got[2].p == ["555-123-4567"] and "Big Blue" in got[2].c and got[2].company and got[2].w == ""
    assert got[3].w == "Manager"


def test_fallback_rules(spark):
    html = [
        "<p>bob @ cs . mit . edu</p>",
        "<a href='#' onclick=\"mailto:one@x.org\">w</a>",
        "<div>Contact <span>two@x.org</span></div>",
        "<p>Write to 'three@x.org' (four@x.org)</p><script>var x = 'hidden@x.org'</script>",
    ]
    df = spark.createDataFrame([(i, "http://h.com/p", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {(r.page_id, h.email, h.method) for r in H.read_pages(df).collect() for h in r.hits}
    assert (0, "bob@cs.mit.edu", "deobfuscation") in got
    assert (1, "one@x.org", "javascript_onclick") in got
    assert {e for i, e, _ in got if i == 2} == {"two@x.org"} and {e for i, e, _ in got if i == 3} >= {"three@x.org", "four@x.org"}
    text = {r.page_id: r.text for r in H.read_text(df).collect()}
    assert text[3] == "Write to 'three@x.org' (four@x.org)"
    assert [r.links for r in H.read_pages(df, ("text",)).collect()] == [[]] * 4


def test_page_text_resolves_whole_entities_once(spark):
    html = ["<title>a &amp; b&amp</title><p>c</p>", "&amp;lt; &ampx; &lt;b&gt; &#39;&#x41;&eacute; AT&T &amp", "<script>&amp</script>&copy;&copy &nbsp; x", None]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r.page_id: r.text for r in H.read_text(df).collect()}
    assert got == {0: "a & b&ampc", 1: "&lt; &ampx; <b> 'A\u00e9 AT&T &amp", 2: "\u00a9&copy x", 3: ""}


def test_pages_that_break_are_named(spark, monkeypatch):
    deep = "<div>" * 30000 + "a@x.org"
    df = spark.createDataFrame([(1, "<p>a@x.org</p>"), (2, deep), (3, None)], "page_id long, html string")
    for read in (people.read_markup_fields, people.read_staff, people.read_hidden):
        rows = read(df).collect()
        assert all((r.error is None) == (r.ord is not None) for r in rows)

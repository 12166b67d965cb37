import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import contacts as C
from tessera.plans import pages
from tessera.sources import html, tables

URL = "http://host.example/p"
FIXTURES = {
    "mailto": ('<p><a href="mailto:jane.roe@acme.org?subject=x">Write</a></p>', [("jane.roe@acme.org", "Jane Roe", "Unknown", "mailto_link", 0.95)]),
    "text wins over mailto": ('<p><a href="mailto:jane.roe@acme.org">Write</a></p><p>info@acme.org</p>', [("info@acme.org", "I. Nfo", "Acme", "text_pattern", 0.75)]),
    "list": ('<ul><li><b>John Doe</b><a href="mailto:john@x.com">john@x.com</a></li></ul>', [("doejohn@x.com", "D. Oejohn", "X", "list_structure", 0.85), ("john@x.com", "J. Ohn", "X", "text_pattern", 0.75)]),
    "table": ("<table><tr><td>Dr. Ada Byron</td><td>ada@cs.mit.edu</td><td>(617) 555-0123</td></tr></table>", [("ada@cs.mit.edu", "Ada Byron", "Cs University", "table_structure", 0.9)]),
    "obfuscated": ("<p>bob [at] acme [dot] com</p>", [("bob@acme.com", "Bob", "Unknown", "deobfuscation", 0.85)]),
    "base64": ('<span data-email="am9obkB4LmNvbQ==">x</span>', [("john@x.com", "J. Ohn", "Unknown", "data_attribute_base64", 0.8)]),
    "card": ('<div class="staff-card">z@x.com</div>', [("z@x.com", "Z", "X", "text_pattern", 0.75)]),
    "nothing": ("<p>no address</p>", []),
    "empty": (None, []),
}


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_fixture(spark, name):
    page, want = FIXTURES[name]
    df = spark.createDataFrame([(1, URL, page)], "page_id long, url string, html string")
    got = [(r.email, r.name, r.company, r.extraction_method, r.confidence) for r in pages.page_contacts(df).orderBy("ord").collect()]
    assert got == want


def test_table_fields(spark):
    df = spark.createDataFrame([(1, URL, FIXTURES["table"][0])], "page_id long, url string, html string")
    r = pages.page_contacts(df).first()
    assert (r.title, r.phone, r.validation_score) == ("Dr", "(617) 555-0123", 0.8999999999999999)


def test_tree_of_odd_markup():
    root = html.parse('<p>a<br>b<p>c</b><script>var t="</p> x@y.com"</script><!-- d -->&amp;e')
    assert root.text(" ", strip=True) == "a b c &e"
    assert html.links(html.parse('<a href="/x#y">1</a><a href=" ../z ">2</a><a>3</a>'), "http://h.com/a/b") == ["http://h.com/x", "http://h.com/z"]


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "value, want",
    [("john.smith@x", "John Smith"), ("jsmith@x", "J. Smith"), ("john@x", "J. Ohn"), ("bob@x", "Bob"), ("a-b@x", "A B")],
)
def test_name_from_email(spark, value, want):
    assert _one(spark, S.name_from_email(F.lit(value))) == want


@pytest.mark.parametrize("value, want", [("a.b@mit.edu", 0.8999999999999999), ("info@x.com", 0.6), ("", 0.5)])
def test_email_score(spark, value, want):
    assert _one(spark, S.email_score(F.lit(value))) == want


@pytest.mark.parametrize("value, want", [("555.123.4567", "(555) 123-4567"), ("+15551234567", "+1 (555) 123-4567"), ("12", None)])
def test_clean_phone(spark, value, want):
    assert _one(spark, S.clean_phone(F.lit(value))) == want


def test_rejected_fields_stay_but_do_not_count(spark):
    df = spark.createDataFrame([(1, "A@x.com", "Click Here", "", None, "", 0.9)], "id long, email string, name string, phone string, title string, company string, confidence double")
    r = C.with_validated(df).first()
    assert (r.email, r.name, r.validation_score) == ("a@x.com", "Click Here", 0.27)


def test_dedup_is_idempotent_and_ignores_row_order(spark):
    rows = [(i, f"u{i % 5}@x.com", float(i % 3)) for i in range(40)]
    make = lambda r: spark.createDataFrame(r, "id long, email string, validation_score double")
    once = C.deduplicate(make(rows), order="id")
    assert sorted(once.collect()) == sorted(C.deduplicate(make(rows[::-1]).repartition(3), order="id").collect())
    assert sorted(C.deduplicate(once, order="id").collect()) == sorted(once.collect())


def test_seeds_and_sinks(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# no\n\n http://a.com/x \nnot a url\n #kept? no\nhttps://b.org\n")
    assert sorted(r.url for r in tables.read_seeds(spark, str(tmp_path / "seeds.txt")).collect()) == ["http://a.com/x", "https://b.org"]
    df = spark.createDataFrame([("a@x.com", "N\nM", None, "", "", "u", "m", 0.5, 0.25, "c" * 1500)], "email string, name string, title string, company string, phone string, source_url string, extraction_method string, confidence double, validation_score double, context string")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert back.name == "N M" and len(back.context) == 1000
    tables.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().email == "a@x.com"
    tables.write_xlsx({"Contacts": df}, str(tmp_path / "x.xlsx"))
    assert b"a@x.com" in zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml")


def test_stream_keeps_first_of_each_address(spark, tmp_path):
    from tessera.streaming.pages import first_seen

    spark.sql("select timestamp'2024-01-01' as ts, 'a@x.com b@x.com a@x.com' as t union all select timestamp'2024-01-01 01:00:00', 'a@x.com'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, t string").parquet(str(tmp_path / "in"))
    q = first_seen(stream, "ts", "t").select("email").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.email for r in spark.table("seen").collect()) == ["a@x.com", "b@x.com"]

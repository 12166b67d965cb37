import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import texts as T
from tessera.operators import matcher as M
from tessera.operators import robots as R
from tessera.sources import people as X


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "text, email, want",
    [
        ("One. Two! Ask a@x.com now? Four. Five. Six.", "a@x.com", "One. Two. Ask a@x. com now. Four"),
        ("no address", "a@x.com", ""),
        (None, "a@x.com", ""),
        ("a@x", "", ""),
        ("............ z" * 30 + " q@x.org", "q@x.org", None),
    ],
)
def test_sentences(spark, text, email, want):
    got = _one(spark, T.sentences_around(F.lit(text).cast("string"), F.lit(email)))
    assert got == want if want is not None else got is not None


def test_markers(spark):
    text = F.lit("a [x] b [ y\n] c [] d [open")
    assert _one(spark, T.between(text, "[", "]")) == ["x", "y"]
    assert _one(spark, T.between(F.lit("To: a \nTo: b"), "To:")) == ["a", "b"]
    assert _one(spark, T.between(F.lit(None).cast("string"), "[", "]")) == []
    assert _one(spark, T.between(text, "")) == []


def test_rules_of_nulls_and_empty_texts(spark):
    for value in (None, "", " "):
        c, e = F.lit(value).cast("string"), F.lit("a@x.com")
        for rule in (T.likely_person(c), T.confident_name(c), T.confident_title(c), T.confident_company(c), T.valid_organization(c), T.name_fits(c, e), T.name_fits_strictly(c, e)):
            assert _one(spark, rule) is False
        assert _one(spark, T.clean_title(c)) is None
        assert _one(spark, T.clean_email(c)) == _one(spark, T.strict_title(c)) == _one(spark, T.complete_phone(c)) == ""
    none = F.array().cast("array<string>")
    assert _one(spark, T.best_name(none, F.lit("a@x.com"))) == _one(spark, T.best_organization(none)) == ""


def test_robots(spark):
    links = spark.createDataFrame([("http://A.com/x/1",), ("http://a.com/y",), ("http://b.com/x",), ("no url",), (None,)], "url string")
    rules = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /x"), ("a.com", ""), ("c.com", None)], "host string, rules string")
    got = {r.url: r.may_fetch for r in R.with_robots(links, rules).collect()}
    assert got == {"http://A.com/x/1": False, "http://a.com/y": True, "http://b.com/x": True, "no url": True, None: True}
    assert R.with_robots(links, rules.limit(0)).filter("may_fetch").count() == 5


def _pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def test_later_persons_win_over_earlier_ones(spark):
    person = '<div itemtype="https://schema.org/Person"><i itemprop="jobTitle">{}</i><u>{}</u></div>'
    r = X.read_markup_fields(_pages(spark, person.format("One", "ann@x.com") + person.format("Two", "ann@x.com"))).first()
    assert (r.email, r.title, r.name, r.company) == ("ann@x.com", "Two", None, None)


def test_card_classes_and_sections(spark):
    filler = "word " * 60  # too long to be a neighbour
    card = f'<div class="team-member"><div><p>{filler} call 555-123-4567</p><span class="job-title">Clerk</span><p>z@y.org {filler}</p></div></div>'
    r = X.read_markup_fields(_pages(spark, card)).first()
    assert (r.title, r.phone) == ("Clerk", "555-123-4567")


def test_staff_lists_by_id_and_no_entries(spark):
    rows = X.read_staff(_pages(spark, '<section id="people"><article><h3>Ada Byron</h3> Dean, Head of it ada@m.edu</article></section>', "<div class=team>a@b.com</div>", None, "")).collect()
    assert [(r.page_id, r.email, r.name, r.title) for r in rows] == [(0, "ada@m.edu", "Ada Byron", "Dean")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Prof. Dr. Ada Byron, ada@x.edu", ("Prof. Dr.", "Ada Byron")),
        ("ada@x.edu is Lecturer Bea Byron", ("", "edu is Lecturer Bea Byron")),  # letters of either case make names
        ("ada@x.edu", ("", "")),
        ("", ("", "")),
    ],
)
def test_academic(text, want):
    assert X.academic(text, "ada@x.edu") == want


def test_academic_on_a_long_line_ends():
    assert X.academic("lower case words " * 2000 + "\nada@x.edu", "ada@x.edu")[0] == ""


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dean\nMary Stone\nq7@x.edu", ("Dean", "Mary Stone")),
        ("Mary\nStone\nq7@x.edu", ("", "Mary\nStone")),
        ("1\n  Prof.\n\n Dr.\n Mary\n J.\n Stone\n\n (q7@x.edu)", ("Prof.\n\n Dr.", "Mary\n J.\n Stone")),
        ("q7\n@1.2\nDean\n\nMary\nStone", ("", "Dean\n\nMary\nStone")),
    ],
)
def test_academic_over_several_lines(text, want):
    assert X.academic(text, "q7@x.edu") == want


def _whole(text, user):
    """The first match in the whole text."""
    name = X._NAME_FIRST.pattern
    return re.search(rf"{name}\s*.*?{user}", text, re.I) or re.search(rf"{user}\s*.*?{name}", text, re.I)


def test_academic_is_that_of_the_whole_text():
    r = random.Random(8)
    parts = ["Dean", "Prof.", "Dr.", "Mary", "Stone", "J.", "J", "1", ",", "q7", "q7@x.edu", "Associate", "Professor", "aq7", "x.y", "\u0131b"]
    for _ in range(20000):
        text = "".join(r.choice(parts) + r.choice([" ", "\n", " \n ", "\n\n", ""]) for _ in range(r.randint(1, 14)))
        m = _whole(text, "q7")
        assert X.academic(text, "q7@x.edu") == (((m[1] or "").strip(), m[2].strip()) if m else ("", "")), text


def test_academic_on_long_texts_ends():
    for text in ("lower case words " * 2000 + "a\n1 q7@x.edu", "lower case words. " * 2000 + "\n1 q7@x.edu", "q7@x.edu " + "lower case words " * 2000, "lower case\n" * 3000 + "1\nq7@x.edu"):
        X.academic(text, "q7@x.edu")


def test_staff_entries_over_several_lines(spark):
    entry = "<li><i>Dean</i>\n  <i>Mary</i>\n  <i>Stone</i>\n  <i>q7@x.edu</i>\n</li>"
    r = X.read_staff(_pages(spark, f'<ul class="staff">{entry}</ul>')).first()
    assert (r.email, r.title, r.name) == ("q7@x.edu", "Dean", "Mary\n  Stone")


def test_hidden(spark):
    html = "<p class='a sr-only'>A@x.com</p><p style='visibility: hidden'>a@x.com b@x.com</p><script>var email = 'c@x.com'; d = \"d\" + \"@\" + \"x.com\"</script>"
    got = [(r.email, r.method) for r in X.read_hidden(_pages(spark, html, None, "<p>e@x.com</p>")).orderBy("page_id", "ord").collect()]
    assert got == [("a@x.com", "css_hidden"), ("b@x.com", "css_hidden"), ("d@x.com", "javascript"), ("c@x.com", "javascript")]


def test_markup_comes_before_the_address(spark):
    df = spark.sql("select 'ada@x.com' as email, '' as text, 'no name' as context, named_struct('name', 'Ada B', 'title', 'Head', 'phone', '', 'company', null) as m")
    r = M.match_contacts(df, markup="m").first()
    assert (r.name, r.title, r.phone, r.company) == ("Ada B", "Head", None, "X")

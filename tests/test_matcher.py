import pytest
from pyspark.sql import functions as F

from tessera.operators import matcher as M


def _one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_names_and_phones(spark):
    text = F.lit("Write to Dr. Ada  Byron, (617) 555-0123 or 555.123.4567; Sales Info")
    assert _one(spark, M.names_in(text))[:1] == ["Ada Byron"]
    assert _one(spark, M.phones_in(text)) == ["617-555-0123", "555-123-4567"]


@pytest.mark.parametrize("email, name, company", [("ada.byron@mail.acme-labs.com", "Ada Byron", "Acme Labs"), ("bob@x.co.uk", "Bob", "X"), ("a1@y.org", None, "Y")])
def test_from_the_address(spark, email, name, company):
    assert _one(spark, M.name_of_address(F.lit(email))) == name
    assert _one(spark, M.company_of_address(F.lit(email))) == company


def test_later_labels_win(spark):
    text = F.lit("Title: Clerk\nRole: Head\nTel: 12 34\nPhone: 99")
    assert _one(spark, M.label_in(text, "title")) == "Head"
    assert _one(spark, M.label_in(text, "phone")) == "12 34"


def test_match_contacts_fills_what_is_missing(spark):
    df = spark.createDataFrame([("ada@x.com", "", "Contact us\nName: Ada B\nCompany: X Ltd", "call 555-123-4567"), ("b.c@y.com", "Kept Name", None, None)], "email string, name string, text string, context string")
    a, b = M.match_contacts(df).collect()
    assert (a.name, a.phone, a.company) == ("Ada B", "555-123-4567", "X Ltd")
    assert (b.name, b.phone, b.company) == ("Kept Name", None, "Y")

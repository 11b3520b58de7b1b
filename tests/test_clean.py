import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwell.functions import clean
from siftwell.functions.names import edits, fold, name_parts
from siftwell.functions.similarity import jaro, winkler


def one(spark, expr, *values, types="string"):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {types}" for n in names))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("New", "New"), (" new ", "New"), ("N-e-w 2", "New"), ("CLOSED_WON", "Closed Won"), ("closed (lost)", "Closed Lost"), ("Trial", None), ("", None), (None, None)])
def test_status(spark, raw, want):
    assert one(spark, clean.status, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("united  kingdom ", "United Kingdom"), ("UAE", "UAE"), ("uae", "Uae"), ("GERMANY", "Germany"), ("\tnew zealand", "New Zealand"), ("  ", None), (None, None)])
def test_country(spark, raw, want):
    assert one(spark, clean.country, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("2024-3-9", dt.date(2024, 3, 9)), ("2024-03-09T10:00:00Z", dt.date(2024, 3, 9)), ("12/31/2025", dt.date(2025, 12, 31)), ("31/12/2025", None), ("2025-02-30", None), ("soon", None), ("", None), (None, None)])
def test_date(spark, raw, want):
    assert one(spark, clean.date, raw) == want


def test_phone(spark):
    assert one(spark, clean.phone_digits, "+44 (0)20-71") == "4402071"
    assert one(spark, lambda c: clean.phone_key(clean.phone_digits(c)), "+44 20 7123 4567") == one(spark, lambda c: clean.phone_key(clean.phone_digits(c)), "(0)20 7123 4567")
    assert one(spark, clean.phone_digits, "none") == ""
    assert one(spark, clean.phone_key, "123") == "123"


def test_email(spark):
    assert one(spark, lambda c: F.concat_ws("|", clean.email_local(c), clean.email_domain(c), clean.domain_root(clean.email_domain(c))), "a.b@x.co.uk") == "a.b|x.co.uk|x"
    assert one(spark, lambda c: F.concat_ws("|", clean.email_local(c), clean.email_domain(c)), "no-at") == "no-at|"
    assert one(spark, lambda c: F.concat_ws("|", clean.email_local(c), clean.email_domain(c)), "a@b@c") == "a|b@c"
    assert sorted(one(spark, clean.email_variants, " Erik.A ")) == ["erik.a", "erika"]


def test_names(spark):
    def parts(first, last, full):
        return one(spark, lambda f, la, w: F.struct(*[v.alias(k) for k, v in clean.resolved_name(f, la, w).items()]), first, last, full)

    r = parts("Inés", " Peña ", None)
    assert (r.display_name, r.name_key, list(r.name_tokens)) == ("Inés Peña", "inespena", ["ines", "pena"])
    r = parts(None, "", "Ji-woo  van Park")
    assert (r.first_name, r.last_name, r.display_name, list(r.name_tokens)) == ("Ji-woo", "Park", "Ji-woo van Park", ["ji-woo", "van", "park"])
    r = parts(None, None, "Cher")
    assert (r.first_name, r.last_name) == (None, "Cher")
    r = parts(None, None, None)
    assert (r.display_name, r.name_key, list(r.name_tokens)) == (None, "", [])


def test_company(spark):
    for text in ("Huang Analytics Consulting", "Huang Robotics", "HUANG Pte. Ltd."):
        assert one(spark, clean.company_core, text) == "huang"
    assert one(spark, clean.company_core, "Group") == "group"
    assert one(spark, clean.company_core, None) == ""


def test_marker(spark):
    text = "Met at expo. Possible duplicate — verify before contacting."
    assert one(spark, clean.has_marker, text)
    assert one(spark, clean.without_marker, text) == "Met at expo."
    assert one(spark, clean.without_marker, "clean note") == "clean note"
    assert not one(spark, clean.has_marker, None)


def test_jaro():
    assert jaro("", "") == 1 and jaro("a", "") == 0 and jaro("abc", "xyz") == 0
    assert round(jaro("martha", "marhta"), 6) == 0.944444
    assert round(winkler("dixon", "dicksonx"), 6) == 0.813333
    assert winkler("abcd", "abxy") > jaro("abcd", "abxy")


def test_edits_is_a_metric():
    words = ["", "a", "ab", "ba", "abc", "acb", "cab", "banana", "bnaana", "bananas", "xbanana"]
    for x in words:
        for y in words:
            assert edits(x, y) == edits(y, x)
            assert (edits(x, y) == 0) == (x == y)
            for z in words:
                assert edits(x, z) <= edits(x, y) + edits(y, z)
    assert edits("ca", "abc") == 2 and edits("abcdef", "uvwxyz", 2) == 3


def test_name_parts():
    assert name_parts("Dr. Maëlle Tevanvel")[:2] == name_parts("TEVANVEL Maelle")[:2] == name_parts("Tevanvel, Maëlle")[:2]
    assert name_parts("Jürgen Z. Yarthal")[:2] == name_parts("Juergen Yarthal")[:2]
    assert name_parts(None) == ("", "", ()) and name_parts("  ") == ("", "", ())
    assert fold("ÅSØß") == "asoss"

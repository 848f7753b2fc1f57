import datetime

import pytest
from pyspark.sql import functions as F

from reportloom.functions import extract as X, predicates as P
from reportloom.schema import ATTACHMENT


def one(spark, function, text):
    return spark.createDataFrame([(text,)], "content string").select(function("content")).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("Date of report: 5 March 2020", "2020-03-05"),
    ("date of report 5th Mar 2020", "2020-03-05"),
    ("Date of report: 05/03/2020", "2020-03-05"),
    ("DATED this 21st day of June 2019", "2019-06-21"),
    ("Date: 1 January 2018", "2018-01-01"),
    ("Date of report: 31 February 2020\nDate: 1 May 2020", "2020-05-01"),
    ("Date of report: 99/99/2020", None),
    ("no date", None),
])
def test_extract_date(spark, text, expected):
    got = one(spark, X.extract_date, text)
    assert (got.isoformat() if got else None) == expected


def test_extract_fields(spark):
    text = "Reference: 2020-0042\nDeceased name: Zoé <i>X</i>\nCoroner's name: A B\nCoroners Area: West\n"
    assert one(spark, X.extract_ref, text) == "2020-0042"
    assert one(spark, X.extract_deceased_name, text) == "Zoé X"
    assert one(spark, X.extract_coroner_name, text) == "A B"
    assert one(spark, X.extract_coroner_area, text) == "West"
    assert one(spark, X.extract_coroner_area, "coroner area: lower") is None


@pytest.mark.parametrize("text, expected", [
    ("Category: Railway related deaths This report is being sent to: X", ["Railway related deaths"]),
    ("Category: railway; POLICE related deaths, railway", ["Railway related deaths", "Police related deaths"]),
    ("Category: Foo  Bar\nBaz • foo", ["Foo", "Bar", "Baz"]),
    ("Category: A|B", ["Accident at Work and Health and Safety related deaths"]),
    ("none", []),
])
def test_extract_categories(spark, text, expected):
    df = spark.createDataFrame([(text,)], "content string")
    got = X.extract_categories(df).first()["categories"]
    if text.endswith("A|B"):
        assert got[0] == expected[0]
    else:
        assert got == expected


@pytest.mark.parametrize("text, expected", [
    ("x CORONER'S CONCERNS: First.  Second ACTION SHOULD BE TAKEN", "First."),
    ("MATTERS OF CONCERN one. two CORONER'S CONCERNS three. four", "three."),
    ("Matters of concern are: a. b. COPIES", "are: a. b."),
    ("SAFETY CONCERNS no stop your response", "no stop"),
    ("CONCERNS IDENTIFIED a. SIGNED: b. Conclusions", "a."),
    ("nothing", ""), (None, ""),
])
def test_extract_concerns(spark, text, expected):
    assert one(spark, X.extract_concerns, text) == expected


def test_extract_concerns_window(spark):
    assert one(spark, X.extract_concerns_window, "MATTERS OF CONCERN  a\nb RECOMMENDATION c") == "a\nb"
    assert one(spark, X.extract_concerns_window, "MATTERS OF CONCERN" + "y" * 3000) == "y" * 3000


@pytest.mark.parametrize("text, expected", [
    ("05/03/2020", "2020-03-05"), ("2020-03-05", "2020-03-05"), ("05-03-2020", "2020-03-05"),
    ("5th March 2020", "2020-03-05"), ("5 Mar 2020", "2020-03-05"), ("March 5, 2020", "2020-03-05"),
    ("soon", None), (None, None),
])
def test_parse_date_any(spark, text, expected):
    got = one(spark, X.parse_date_any, text)
    assert (got.isoformat() if got else None) == expected


@pytest.mark.parametrize("year, other, title, content, expected", [
    (2001, None, "2005", "2006", (2001, None)),
    (None, "x 01/02/2003", "2005", "2006", (2003, "other_date_column")),
    (None, None, "Report 2005", "2006", (2005, "extracted_from_title")),
    (None, None, "t", "in 2001, on 3/4/2002 and 2001", (2002, "date_in_content")),
    (None, None, "t", "2001 2003 2003 2001 1999", (2001, "year_in_content")),
    (None, None, "t", "2090 2090 2010 2011", (2011, "year_in_content")),
    (None, None, "t", "2090", (2090, "year_in_content")),
    (None, None, "t", "no 12345", (None, None)),
])
def test_backfill_year(spark, year, other, title, content, expected):
    df = spark.createDataFrame([(year, other, title, content)], "year int, received string, title string, content string")
    row = X.backfill_year(df, ["received"], current_year=2025).first()
    assert (row["year"], row["year_source"]) == expected


def attachments(spark, content, concerns, pdfs):
    schema = f"content string, extracted_concerns string, pdfs array<{ATTACHMENT.simpleString()}>"
    return spark.createDataFrame([(content, concerns, pdfs)], schema)


def test_fill_from_attachments(spark):
    pdfs = [(1, "a", "no section", None, "report"), (2, "b", "SAFETY CONCERNS: a long enough concern text.", None, "report")]
    df = attachments(spark, " ", "short", pdfs)
    assert X.fill_content_from_attachment(df).first()["content"] == "no section"
    row = X.fill_concerns_from_attachments(df).first()
    assert (row["extracted_concerns"], row["concern_source"]) == ("a long enough concern text.", "attachment_2")
    kept = X.fill_concerns_from_attachments(attachments(spark, "c", "a concern of twenty chars", pdfs)).first()
    assert (kept["extracted_concerns"], kept["concern_source"]) == ("a concern of twenty chars", None)
    assert X.fill_content_from_attachment(attachments(spark, "c", None, pdfs)).first()["content"] == "c"


@pytest.mark.parametrize("pdf, title, content, expected", [
    (("Reply.pdf", "report"), "t", "c", True), (("x.pdf", "Response"), "t", "c", True),
    (("x.pdf", "report"), "Answered", "c", True), (("x.pdf", None), "t", "Following the Regulation 28 report", True),
    (("x.pdf", "report"), "t", "c", False), ((None, None), None, None, False),
])
def test_is_response(spark, pdf, title, content, expected):
    df = spark.createDataFrame(
        [([(1, pdf[0], None, None, pdf[1])], title, content)],
        f"pdfs array<{ATTACHMENT.simpleString()}>, title string, content string")
    assert df.select(X.is_response()).first()[0] is expected
    assert df.filter(P.document_type(["Response"])).count() == int(expected)
    assert df.filter(P.document_type(["Report", "Response"])).count() == 1


def test_letter_fields(spark):
    letters = [
        "Acme Ltd\nplain\nDate: 5th March 2020\nDear Sir;\nskip\nBody",
        "Subject: X\nMon, 3 May 2021 text\nMrs Lee,\nskip\nBody 2",
        "Date: soon in 2019\nTo Whom,\nskip\nBody 3",
        "nothing here",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(letters)], "i int, text string")
    a, b, c, d = X.letter_fields(df).orderBy("i").collect()
    assert (a["date_of_report"], a["year"], a["addressee"], a["body"], a["status"]) == ("05/03/2020", 2020, "Sir", "Body", "success")
    assert a["sender_address"] == "Acme Ltd Date: 5th March 2020"
    assert (b["subject"], b["date_of_report"], b["addressee"], b["body"]) == ("Subject: X", "03/05/2021", "Mrs Lee", "Body 2")
    assert (c["date_of_report"], c["year"], c["addressee"], c["body"]) == ("soon in 2019", 2019, "Whom", "Body 3")
    assert (d["date_of_report"], d["status"], d["subject"], d["addressee"]) == (None, "failed", "", "")


def test_sections_and_summary(spark):
    text = "Ref: 1\nDate of report: 1/2/2020\nDeceased name: Z\nCIRCUMSTANCES OF DEATH fell CORONER'S CONCERNS wet MATTERS OF CONCERN floor\n\nend"
    df = spark.createDataFrame([(text,)], "content string")
    row = X.document_summary(df).first()
    for name in ("circumstances", "concerns", "actions"):
        part = row[name]
        assert text[part["start"]:part["end"]] == part["source"]
        assert part["content"] in part["source"]
    assert row["confidence"] == 1.0
    assert row["extractive"].startswith("CIRCUMSTANCES:\nfell\n\n")
    assert row["abstractive"].startswith("Prevention of Future Deaths report 1 dated 1/2/2020 regarding the death of Z")


def test_keyword_search_and_negation(spark):
    df = spark.createDataFrame([("Alpha beta",), ("gamma",), (None,)], "c string")
    hits = lambda q: [r[0] for r in df.select(P.keyword_search("c", q)).collect()]
    assert hits("alpha AND beta") == [True, False, False]
    assert hits("beta or gamma") == [True, True, False]
    assert hits("alpha and beta or x") == [False, False, False]
    assert hits("") == [False, False, False]
    s = spark.createDataFrame([("Staff can't cope",), ("Delays happen",), ("All good",)], "s string")
    assert [r[0] for r in s.select(P.contains_negation("s")).collect()] == [True, True, False]


def test_partial_match_counts_null_as_contained(spark):
    df = spark.createDataFrame([("West London",), ("London",), ("Kent",), (None,)], "a string")
    assert df.filter(P.partial_match("a", ["Greater London", "west"])).count() == 3


def test_date_filter_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(datetime.date(2020, 1, d),) for d in (1, 2, 3, 4)], "d date")
    assert df.filter(P.date_between("d", "2020-01-02", "2020-01-03")).count() == 2
    assert df.select(F.year("d").alias("y")).filter(P.year_between("y", 2020, 2020)).count() == 4

import re

import pytest
from pyspark.sql import functions as F

from reportloom.functions import text as T


def run(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.withColumn("o", function("v")).orderBy("i").select("o").collect()]


def test_clean_text(spark):
    got = run(spark, T.clean_text, [
        "Itâ€™s <b>bold</b> x", "café ﬁne", "a​b–c", "a\tb  c\n\n\nd ", None,
        "“q” ’",
    ])
    assert got == ["It's bold x", "café fine", "ab-c", "a b c\nd", "", "\"q\" '"]


def test_clean_text_without_normalisation_matches_on_ascii(spark):
    values = ["plain <i>text</i>  here", "a\n\nb"]
    assert run(spark, T.clean_text, values) == run(spark, lambda c: T.clean_text(c, False), values)


def test_clean_text_for_modeling(spark):
    got = run(spark, T.clean_text_for_modeling, [
        "See https://a.b/c and www.x.org or mail me@x.org about 555-123-4567 trains",
        "On 3rd March 2020 at 10:30 (12/03/2020) wheels turned very slowly",
        "Ref no. 2020-0012 paragraph 7 the coroner signed three lovely letters",
        "one two", None,
    ])
    assert got == [
        "see and mail about trains", "wheels turned very slowly", "the three lovely letters", "", "",
    ]


def test_clean_deceased_name(spark):
    got = run(spark, T.clean_deceased_name, [
        "Deceased name: John  Smith", "Coroner's name: Ann Lee", "John Smith Ref: 2020-1",
        "Jane Doe (aged 4)", "Name of deceased: Al B Coroner C", None,
    ])
    assert got == ["John Smith", "Ann Lee", "John Smith", "Jane Doe", "Al B", None]


def test_clean_coroner_name(spark):
    got = run(spark, T.clean_coroner_name, [
        "Dr Dr. Jane Doe QC", "HM Senior Coroner X", "Mr J. Smith, ", "Prof A (Assistant) B Esq.",
        "Justice Judge Kim Coroner for Y", "Sir Tom;", None,
    ])
    assert got == ["Jane Doe", "Senior", "J. Smith", "A B", "Kim", "Tom", None]


def test_clean_coroner_area(spark):
    got = run(spark, T.clean_coroner_area, [
        "The City of Kingston upon Hull & the East Riding of Yorkshire", "Cornwall and the Isle of Scilly",
        "North-West [Wales] (Bangor)", "Devon | Category: x", "Kent This report is being sent to: Y",
        "Essex Matters of Concern", "  Surrey. ", None,
    ])
    assert got == [
        "kingston upon hull and east riding", "cornwall and isles of scilly", "north west wales bangor",
        "devon", "kent", "essex", "surrey", None,
    ]


def test_clean_categories(spark):
    df = spark.createDataFrame([(["Rail & road (UK) This report is sent", "Plain"],)], "c array<string>")
    assert df.select(T.clean_categories("c")).first()[0] == ["Rail and road", "Plain"]


@pytest.mark.parametrize("raw, expected", [
    ("railway related deaths", "Railway related deaths"),
    ("Suicide", "Suicide from 2015"),
    ("all Police related deaths here", "Police related deaths"),
    ("related deaths", "Accident at Work and Health and Safety related deaths"),
    ("nothing", "nothing"),
    ("", None),
])
def test_match_category(spark, raw, expected):
    assert run(spark, T.match_category, [raw]) == [expected]


def test_slug_from_filename(spark):
    got = run(spark, T.slug_from_filename, [
        "John-Smith-Prevention-of-future-deaths-report-2020-0001_Published.pdf", "Jane Doe REGULATION 28.pdf",
        "Al B 2021-0007.pdf", "O'Neil & Co.pdf", "2020.pdf",
    ])
    assert got == ["john-smith", "jane-doe", "al-b", "oneil-co", "2020"]


def test_preprocess_counts(spark):
    rows = spark.createDataFrame([(1, "The reports of 3 ladies and boxes"), (2, ""), (3, "the of")], "id int, content string")
    done = T.preprocess_corpus(rows)
    got = {r["id"]: r for r in done.collect()}
    assert got[1]["processed"] == "report lady box"
    assert (got[1]["original_words"], got[1]["processed_words"], got[1]["reduction_pct"]) == (7, 3, 57.14)
    assert got[2]["reduction_pct"] == 0.0
    summary = T.preprocess_summary(done).first()
    assert (summary["documents"], summary["empty_documents"]) == (3, 2)


def test_sentence_offsets_point_into_the_text(spark):
    texts = ["One. Two! three? Four", "  Lead. \n\n Next.No split. Éa. End.", "", "A", "x.  Y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id int, content string")
    for r in T.split_sentences(rows).collect():
        assert texts[r["record_id"]][r["start"]:r["end"]] == r["sentence"]
    pieces = [p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z])", texts[1]) if p.strip()]
    got = T.split_sentences(rows.filter("record_id = 1")).orderBy("sentence_idx").collect()
    assert [r["sentence"] for r in got] == pieces


def test_confidence_label_limits(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.5,), (0.49,)], "s double")
    assert [r[0] for r in df.select(T.confidence_label("s")).collect()] == ["High", "Medium", "Medium", "Low"]


def test_tokens_follow_unicode_words(spark):
    assert run(spark, lambda c: T.tokens(c), ["Été a b2 c'est"]) == [["été", "b2", "est"]]
    assert run(spark, T.apostrophe_tokens, ["Can't self-harm - x"]) == [["can't", "self-harm", "x"]]


def test_format_date_uk(spark):
    df = spark.createDataFrame([("2020-03-05",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert [r[0] for r in df.select(T.format_date_uk("d")).collect()] == ["05/03/2020", ""]

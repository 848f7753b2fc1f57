"""Links, entities, numbered attachment columns and names, by hand rows."""

import pytest
from pyspark.sql import functions as F

from reportloom.functions.text import clean_coroner_name, match_category
from reportloom.sources import files
from reportloom.sources.pages import absolute_url, unescape

LINKS = {
    "//cdn.org/a.pdf": "https://cdn.org/a.pdf", "mailto:a@b.c": "mailto:a@b.c", "doc.pdf": "https://s.org/dir/sub/doc.pdf",
    "../x/y.pdf": "https://s.org/dir/x/y.pdf", "/r?a=1&amp;b=2": "https://s.org/r?a=1&b=2", "#top": "https://s.org/dir/sub/page?x=1#top",
    "?q=1": "https://s.org/dir/sub/page?q=1", "": "https://s.org/dir/sub/page?x=1", "./a/./b/": "https://s.org/dir/sub/a/b/",
    "../../../z": "https://s.org/z", "HTTPS://q.org/x": "HTTPS://q.org/x",
}
ENTITIES = {
    "It&#8217;s &eacute; &ndash;": "It’s é –", "&amp;lt; &nope; &#x1F600; &#xD800;": "&lt; &nope; 😀 &#xD800;",
    "a & b&nbsp;c": "a & b c", "none": "none", "&copy;&middot;&apos;": "©·'", None: None,
}


def results(spark, rows, column):
    return {r[0]: r[1] for r in spark.createDataFrame([(v,) for v in rows], "v string").select("v", column.alias("out")).collect()}


def test_links_are_resolved(spark):
    base = F.lit("https://s.org/dir/sub/page?x=1")
    assert results(spark, LINKS, absolute_url(F.col("v"), base)) == LINKS


def test_entities_are_decoded_once(spark):
    assert results(spark, ENTITIES, unescape(F.col("v"))) == ENTITIES


@pytest.mark.parametrize("title", ["Dr", "Dr.", "Doctor", "Mr", "Mr.", "Mrs.", "Ms.", "Miss", "Miss.", "Prof.", "Professor", "Sir", "Dame", "HM", "Hon.", "Judge"])
def test_titles_are_stripped(spark, title):
    assert results(spark, [f"{title} Jane Doe"], clean_coroner_name("v")) == {f"{title} Jane Doe": "Jane Doe"}


def test_category_of_separators_stays(spark):
    assert results(spark, [" / - ", "Railway"], match_category("v")) == {" / - ": " / - ", "Railway": "Railway related deaths"}


def test_attachments_beyond_nine_are_kept(spark):
    wide = spark.createDataFrame([("a", "twelve", "two", "x")], "id string, PDF_12_Name string, PDF_2_Name string, PDF_Note string")
    row = files.pack_attachments(wide).first()
    assert [(p.pos, p.name) for p in row.pdfs] == [(2, "two"), (12, "twelve")] and row.PDF_Note == "x"


def test_long_names_stay_apart(spark):
    rows = [("r", "n" * 60 + end, 2020, 1) for end in "ab"]
    df = spark.createDataFrame(rows, "ref string, deceased_name string, year int, record_id int")
    assert df.select(files.case_folder()).distinct().count() == 2


def test_json_lines_round_trip(spark, tmp_path):
    """Line breaks and quotes inside a text stay one line; rows without JSON are left out, missing fields null."""
    from reportloom.sources import files

    path, text = str(tmp_path / "j"), 'a "b"\nc\u2028d\\e'
    rows = spark.createDataFrame([(1, text), (2, None)], "id int, t string").selectExpr("to_json(struct(*)) AS json")
    files.write_json_lines(rows.unionByName(spark.sql("SELECT CAST(NULL AS string) AS json")), path)
    got = files.read_json_lines(spark, path, "id int, t string, other double").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, text, None), (2, None, None)]

"""Cards of listing pages by hand-made markup."""

from reportloom.sources.cards import listing_cards

LISTING = """<!DOCTYPE html><html><body><div class="card"><h3 class="card__title"><a href="/outside">Outside</a></h3></div>
<ul class="wide search__list"><!-- <div class="card"> -->
<li><div class="card big"><div class='inner'><div>deep</div><h3 class="card__title"><a class="x" href="/r/record-id-17/?a=1&amp;b=2">First <b>re</b>port &amp; more</a></h3></div>
  <div class="text">One <div>two</div> 1 < 2</div><p>left open</div>
<li><DIV CLASS="card"><h3 class="card__title">No link</h3><a href="/not-in-title">x</a></DIV>
<li><div class="card"><h3 class="other"><a href="/o">Other</a></h3><h3 class="card__title"><a name="top">anchor</a><a href="two.html">Second</a></h3>
  <div class="card"><h3 class="card__title"><a href="https://q.org/record-id-5">Inner</a></h3></div></div>
<li><div class="cards"><h3 class="card__title"><a href="/no">Not a card</a></h3></div>
</ul><ul class="search__list"><div class="card"><h3 class="card__title"><a href="/late">Late</a></h3></div></ul></body></html>"""
FIRST = ("First report & more", "https://s.org/r/record-id-17/?a=1&b=2", "17", "One two 1 < 2")
EXPECTED = [FIRST, ("Second", "https://s.org/list/two.html", None, None), ("Inner", "https://q.org/record-id-5", "5", None)]


def cards(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id int, url string, html string, pos int, title string, card string")
    out = listing_cards(df, fields={"summary": ("div", "text")}, **options)
    assert out.columns == ["page_id", "card", "title", "url", "record_id", "summary"]
    return [tuple(r) for r in out.orderBy("page_id", "card").collect()]


def test_cards_of_a_listing(spark):
    got = cards(spark, [(1, "https://s.org/list/", LISTING, 1, "t", "c")])
    assert got == [(1, n, *row) for n, row in enumerate(EXPECTED, 1)]


def test_repeated_empty_and_plain_pages(spark):
    base = "https://s.org/list/"
    rows = [(p, base, html, 0, None, None) for p, html in [(1, LISTING), (1, LISTING), (2, None), (3, ""), (4, "<p>text < text"), (5, LISTING)]]
    got = cards(spark, [*rows, (None, base, LISTING, 0, None, None)])
    assert got == [(p, n, *row) for p in (None, 1, 5) for n, row in enumerate(EXPECTED, 1)]
    assert cards(spark, rows[2:5]) == [] and cards(spark, []) == []


def test_unclosed_cards_and_stray_ends(spark):
    html = '</div></div><ul class="search__list"><div class="card"><h3 class="card__title"><a href="/a">A</a></h3><div class="card"><h3 class="card__title"><a href="/b">B'
    assert [r[2:4] for r in cards(spark, [(1, "https://s.org/", html, 0, None, None)])] == [("A", "https://s.org/a"), ("B", "https://s.org/b")]


def test_many_cards_on_a_page(spark):
    one = '<div class="card"><h3 class="card__title"><a href="/r/record-id-{0}">T{0}</a></h3><div class="text">S{0}</div></div>'
    html = '<ul class="search__list">' + "".join(one.format(i) for i in range(5000)) + "</ul>"
    got = cards(spark, [(1, "https://s.org/", html, 0, None, None)])
    assert got == [(1, i + 1, f"T{i}", f"https://s.org/r/record-id-{i}", str(i), f"S{i}") for i in range(5000)]

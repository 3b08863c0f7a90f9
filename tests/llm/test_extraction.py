"""Page differencing: alignment, markup, partners."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulframe.llm import extraction, html_lines
from haulframe.llm.extraction import common_places, main_text, shared_lines
from haulframe.llm.html_lines import ARTICLE, ASIDE, OPEN, lines_of

numbers = st.lists(st.integers(0, 5), max_size=30)


@settings(max_examples=300, deadline=None)
@given(numbers, numbers, st.sampled_from([1, 5, 10_000]))
def test_alignment_is_longest(a, b, cells):
    before, extraction._TABLE = extraction._TABLE, cells
    try:
        places = common_places(a, b)
    finally:
        extraction._TABLE = before
    rest = iter(b)
    assert places == sorted(set(places)) and all(a[i] in rest for i in places)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(places) == best[-1][-1]


def test_lines_of_broken_markup():
    html = (
        '<!DOCTYPE html><head><title>T</title><script>if (a<b) "</p>"</script><body><header>Site</header>'
        '<div id=top class="x cookie-notice">We use <b>cookies</b></div><!-- <p>no</p> -->'
        '<article class="post-header"><header><h1>A &amp; B&nbsp; c</h1></header><p>one<b>two</i> <a href="a>b">th</a>ree<br>four<p>fi\n ve &#233;&lt'
        '<section class="comments"><p>nice</section><form>mail <input> me</form><style>p{}</style><p>6 < 7</article><div>after'
    )
    assert lines_of(html) == [
        ("Site", ASIDE), ("We use cookies", ASIDE), ("A & B c", ARTICLE), ("onetwo three", ARTICLE), ("four", ARTICLE), ("fi ve é<", ARTICLE),
        ("nice", ASIDE), ("mail me", ASIDE), ("6 < 7", ARTICLE), ("after", OPEN),
    ]
    assert lines_of("") == [] and lines_of("<") == [("<", OPEN)] and lines_of("a <!-- open") == [("a", OPEN)]
    assert lines_of("x" + "<a href='" * 2000)[0] == ("x", OPEN)


def test_marks_inside_a_line_do_not_leak():
    assert lines_of('<p>a <span class="ad">b <span>c</span> d</span> e</p>') == [("a", OPEN), ("b c d", ASIDE), ("e", OPEN)]
    assert lines_of("<ul><li>a<li>b</ul><b>c") == [("a", OPEN), ("b", OPEN), ("c", OPEN)]


def page(body):
    return f"<html><body>{body}</body></html>"


def soup(n):
    """No element says what is main text."""
    own = "".join(f"<div>sentence {k} of page number {n} that no other page has, with quite a few words in it</div>" for k in range(3))
    return page(f"<div>Home</div><div>News</div>{own}<div>Imprint</div><div>Contact us</div>")


def texts(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, shared string, path int")
    shared = {r["_url"]: len(r["shared"]) for r in extraction.shared_line_numbers(df, **more).collect()}
    return {(r["page_id"], r["url"]): (r["text"], r["n_chars"], shared.get(r["url"], 0)) for r in extraction.extract(df, **more).collect()}


def test_shared_lines_go_without_markup(spark, monkeypatch):
    monkeypatch.setattr(extraction, "BLOCK", 3)  # neighbours across many borders
    rows = [(i, f"http://h{i % 2}.org/a/{i:03}", soup(i), "x", None, i) for i in range(40)]
    rows += [(100, "http://alone.org/a", soup(100), None, None, None), (101, None, soup(101), None, None, None)]
    found = texts(spark, rows)
    for i in range(40):
        text, n, shared = found[i, f"http://h{i % 2}.org/a/{i:03}"]
        assert text == " ".join(f"sentence {k} of page number {i} that no other page has, with quite a few words in it" for k in range(3))
        assert n == len(text) and shared == 4
    assert found[100, "http://alone.org/a"][0].startswith("Home News") and found[101, None][0].endswith("Contact us")


def test_copies_are_no_partners(spark):
    rows = [(i, f"http://h.org/{i}", soup(7), None, None, None) for i in range(4)]
    assert all(v[0].startswith("Home News sentence") and v[2] == 0 for v in texts(spark, rows).values())
    # beyond the copies there is a page that shows the template
    rows = rows[:2] + [(9, "http://h.org/9", soup(9), None, None, None)]
    assert all(v[0].startswith("sentence") for v in texts(spark, rows).values())


def test_marked_articles_keep_what_they_share(spark):
    passage = "a passage of the licence that many pages of this host quote word for word in their articles"
    rows = [
        (i, f"http://h.org/{i}", page(f"<nav>Home</nav><div class='ad'>Buy {i}</div><article><h1>{i}</h1><p>{passage}</p><p>{'own words ' * (12 + i)}</p></article><footer>x{i}</footer>"), None, None, None)
        for i in range(5)
    ]
    found = texts(spark, rows)
    assert {v[0] for v in found.values()} == {f"{i} {passage} {' '.join(['own words'] * (12 + i))}" for i in range(5)}
    assert {v[2] for v in found.values()} == {2}  # the passage, which is the article's own, and the menu


def test_odd_pages(spark):
    odd = [
        (1, "http://h.org/1", None, None, None, None), (1, "http://h.org/1", "", None, None, None), (2, "no url", "<p>x</p>", None, None, None),
        (None, "http://h.org/2", "<p>only &eacute;</p>", None, None, None), (3, "http://h.org/3", "<p>" + "long " * 100_000, None, None, None),
    ]
    df = spark.createDataFrame(odd, "page_id bigint, url string, html string, text string, n_chars string, lines int")
    found = extraction.extract(df)
    assert found.columns == ["page_id", "url", "lines", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in found.collect()) == [0, 0, 1, 6, 499_999]
    assert extraction.extract(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "http://h.org/1", "<p>same</p>")] * 3, "page_id int, url string, html string")
    assert [r["text"] for r in extraction.extract(twice).collect()] == ["same"] * 3


def test_rules_of_one_page():
    assert shared_lines([], [], [[1]]) == [] and shared_lines([1, 2, 3], [5, 50, 5], [[1, 3], [2, 1]]) == [0, 2]
    assert main_text([("menu", ASIDE), ("a", OPEN), ("b", OPEN)], [2]) == "a"
    assert main_text([("a", OPEN), ("m", html_lines.MAIN), ("x", ARTICLE)], []) == "x"


def test_marked_articles_are_differenced_too(spark):
    body = lambda i: f"<nav>Home</nav><article><p>a passage that all of them quote</p><p>{'own words ' * (12 + i)}</p></article><footer>Imprint</footer>"
    rows = [(i, f"http://h.org/{i}", page(body(i))) for i in range(5)]
    rows += [(10 + i, None, html) for i, html in enumerate([page(body(10)), None, ""])]  # no partner
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r for r in extraction.extract(df, counts=True).collect()}
    assert found[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "n_deleted", "n_restored"} and len(found) == 8
    for i in (0, 1, 2, 3, 4, 10):
        assert found[i]["text"] == f"a passage that all of them quote {' '.join(['own words'] * (12 + i))}"
        # menu, passage and imprint are deleted, the passage comes back
        assert (found[i]["n_deleted"], found[i]["n_restored"]) == ((3, 1) if i < 10 else (0, 0))
    assert found[11]["text"] == found[12]["text"] == ""
    assert extraction.kept_lines([("menu", ASIDE), ("a", ARTICLE), ("b", ARTICLE), ("c", OPEN)], [0, 2]) == ([1, 2], [2])


def test_pages_without_a_key_are_dealt(spark):
    df = spark.createDataFrame([(i, None, None) for i in range(400)], "page_id bigint, url string, html string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["count"] for r in extraction.extract(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 400 and len(sizes) == 4 and max(sizes) < 200

"""Awkward rows through every operator and stage: nulls, blanks, long texts, ties, repeats, empty tables, other columns."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rows import awkward, documents, prose
from tillroll.llm import (
    decontamination,
    html_extraction,
    language_id,
    mixing,
    quality_rules,
    queries,
    sharding,
    simhash,
    site_quality,
    substring_dedup,
    url_filters,
)

PAGES = "page_id bigint, url string, html string, host string, Verdict string"
BENCH = "item_id bigint, text string, items string"


def benchmark(spark, rows=None):
    found = [(1, prose(2, 60), "x"), (2, "one two three", "x"), (None, prose(2, 60), "x"), (3, None, "x"), (4, "", "x")]
    return spark.createDataFrame(found if rows is None else rows, BENCH)


def pages(spark, rows=None):
    found = [
        (1, "http://Ab.Example.NET/en/1?x", "<p>One, two &amp; three four</p>", "old", "old"),
        (2, None, None, None, None),
        (3, "no scheme", "", "old", "old"),
        (3, "no scheme", "", "old", "old"),
        (4, "x://h", "<<<", "old", "old"),
        (None, "x://h" + "/a" * 2000, "<div>" * 500 + "deep" + "<b>" * 500, "old", "old"),
    ]
    return spark.createDataFrame(found if rows is None else rows, PAGES)


def embeddings(spark, rows=None):
    """14 vectors of 64 finite numbers, of which 6 are zero and two are queries; others are not complete."""
    found = [(i, [float((7 * i + j) % 11) for j in range(64)], 0) for i in (0, 1, 2, 3, 4, 5, 6, 100)]
    found += [(i, [0.0] * 64, None) for i in (200, 201, 202, 203, 204, 205)]
    found += [(300, None, 0), (301, [1.0] * 63 + [None], 0), (302, [1.0] * 63 + [float("nan")], 0), (303, [float("inf")] * 64, 0)]
    return spark.createDataFrame(found if rows is None else rows, "vec_id bigint, embedding array<float>, label int")


def conversations(spark, rows=None):
    """A conversation of 13 turns, some without number, role or text, or twice; a turn of no conversation."""
    found = [(0, i, "user" if i % 2 else None, f"turn {i}" if i % 3 else None) for i in range(10)]
    found += [(0, 9, "user", "again"), (0, None, "user", ""), (0, None, None, None), (None, 1, "user", "lost")]
    return spark.createDataFrame(found if rows is None else rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.fixture
def tables(spark, tmp_path):
    """Writes the tables of a query, awkward or empty, and returns their folder."""

    def write(empty: bool) -> str:
        none = [] if empty else None
        folder = tmp_path / str(empty)
        frames = {
            "documents": documents(spark, none).select("doc_id", "text", "lang", "source", "n_chars"),
            "benchmark": benchmark(spark, none).select("item_id", "text"),
            "pages": pages(spark, none).select("page_id", "url", "html"),
            "embeddings": embeddings(spark, none),
            "conversations": conversations(spark, none),
            "labels": spark.createDataFrame(
                [] if empty else [(1, 1, 0), (1, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None)],
                "doc_id bigint, quality int, toxic int",
            ),
        }
        for name, frame in frames.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_take_awkward_and_empty_tables(spark, tables, name):
    query = queries.queries()[name]
    rows = query(spark, tables(False)).collect()
    assert len(rows) == (6 if "page_id" in rows[0] else len(awkward()))
    none = query(spark, tables(True))
    assert none.collect() == [] and none.columns == list(rows[0].asDict())


def test_pipeline_takes_awkward_and_empty_tables(spark, tables):
    rows = corpus_pipeline.run(spark, tables(False)).collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in awkward()}
    assert corpus_pipeline.run(spark, tables(True)).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, tables, name, stage):
    folder = tables(False)
    docs = documents(spark)
    out = stage(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    known = {tuple(r) for r in docs.collect()}
    kept = [tuple(r) for r in out.collect()]
    assert kept and set(kept) <= known
    assert stage(spark, documents(spark, []), folder).collect() == []


def test_rules_judge_null_like_empty(spark):
    rows = quality_rules.apply_policy(quality_rules.ledger(documents(spark)), "v1").collect()
    rows = {r["doc_id"]: r for r in rows}
    assert rows[3]["n_words"] == rows[4]["n_words"] == rows[5]["n_words"] == 0
    assert not rows[3]["kept"] and not rows[12]["kept"] and rows[1]["kept"]
    assert rows[12]["n_repeat_words"] == 200 and rows[9]["word_chars"] == 22  # a no-break space is none


def test_one_of_each_keeps_the_first(spark):
    out = [tuple(r) for r in simhash.one_of_each(documents(spark)).collect()]
    ids = sorted((r[0] is None, r[0]) for r in out)
    # 1 and the two rows of 2 are equal, 3, 4 and 5 are empty, the rows without an id are equal
    assert [i for _, i in ids if i is not None] == [1, 3, 6, 7, 8, 9, 11, 12]
    assert len([r for r in out if r[0] is None]) == 1


def test_component_of_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c d"), (8, "c d")], "doc_id bigint, text string")
    prints = simhash.with_fingerprint(docs, "fp").select("doc_id", "fp")
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(prints).collect()}
    assert found == {(None, None), (7, 7), (8, 7)}


def test_items_shorter_than_a_window(spark):
    found = decontamination.find_spans(documents(spark), benchmark(spark))
    assert found.columns == [*[c for c in documents(spark).columns if c != "n_words"], "n_words", "spans", "items"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[11]["items"] == ["2"] and [tuple(s) for s in rows[11]["spans"]] == [(0, 2)]
    assert rows[7]["items"] == ["1"] and [tuple(s) for s in rows[7]["spans"]] == [(40, 99)]
    assert rows[3]["spans"] == [] and rows[3]["n_words"] == 0
    cut = {r["doc_id"]: r["text"] for r in decontamination.without_spans(found).collect()}
    assert cut[11] == "" and cut[3] is None and "w" in cut[7]
    none = decontamination.find_spans(documents(spark), benchmark(spark, []))
    assert none.filter(F.size("spans") > 0).count() == 0


def test_short_items_are_cut_out_of_documents(spark):
    texts = {1: "a b One, two three c", 2: "one two three", 3: "x one two one two three three y", 4: f"p {prose(2, 60)} q"}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id bigint, text string, n_chars bigint")
    out = {r["doc_id"]: r for r in decontamination.clean_documents(docs, benchmark(spark)).collect()}
    assert {i: r["text"].split() for i, r in out.items()} == {1: ["a", "b", "c"], 3: ["x", "y"]}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_mixing_of_empty_sources_and_repeats(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "c", None), (4, "d " * 8, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.per_row(mixing.plan(docs)).collect()
    assert len(out) == 5
    by = {r["source"]: r for r in out}
    assert by["y"]["target"] == 0 and by["y"]["taken"] == 0
    assert sum({r["source"]: r["target"] for r in out}.values()) == pytest.approx(13)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in out)


def test_shards_of_extra_columns_and_equal_rows(spark):
    docs = documents(spark)
    out = sharding.assign_shards(docs, [F.xxhash64("text"), F.col("doc_id")], F.length("text"), 3)
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]
    assert out.count() == docs.count()
    zero = sharding.assign_shards(docs, [F.col("doc_id")], F.lit(0), 3)
    assert {r["shard"] for r in zero.collect()} == {0}


def test_languages_without_letters_or_labels(spark):
    docs = documents(spark)
    model = language_id.learn(docs)
    rows = {r["doc_id"]: r for r in language_id.predict(spark, model, docs).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[5]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    clash = docs.withColumns({"Score": F.lit("old"), "Lang_Pred": F.lit("old")})
    assert language_id.predict(spark, model, clash).columns == [*[c for c in docs.columns if c != "text"], "lang_pred", "score", "ambiguous"]
    nothing = language_id.learn(docs.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in language_id.predict(spark, nothing, docs).collect()} == {"und"}
    single = language_id.learn(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.predict(spark, single, docs).collect()} == {"und", "en"}


def test_without_labels_nothing_is_known(spark):
    docs = documents(spark).select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.createDataFrame([], "doc_id bigint, low int, toxic int")
    assert {(r["low"], r["toxic"]) for r in site_quality.judged(docs, labels).collect()} == {(0.5, 0.5)}


def test_short_texts_lose_nothing(spark):
    rows = {r["doc_id"]: r for r in substring_dedup.without_repeats(documents(spark)).collect()}
    assert rows[11]["n_removed"] == 0 and rows[3]["n_words"] == 0 and rows[3]["kept"] == ""
    assert rows[1]["n_removed"] == 50 and rows[7]["n_removed"] == 60 and rows[8]["n_removed"] == 60
    assert rows[12]["n_removed"] == 200


def test_rules_and_templates_of_urls(spark):
    rules = queries.URL_RULES
    expected = {
        "https://a.Example.NET/en/1": ("example.net/en/", "allow"),
        "https://example.net/de/1": ("net/", "block"),
        "https://notexample.net/en/": ("net/", "block"),
        "ftp://www.example.com/de/": ("example.com/de/", "block"),
        "http://x.org/fr/9#a": ("org/fr/", "allow"),
        "http://x.org/fr": (None, "allow"),
        "http://net": (None, "allow"),
        "none": (None, "allow"),
    }
    frame = spark.createDataFrame([(u, 1) for u in expected], "url string, _label_key bigint")
    labels = spark.createDataFrame([], "key bigint, bad int")
    out = url_filters.judged(frame, labels, rules)
    assert {r["url"]: (r["rule"], r["verdict"]) for r in out.collect()} == expected


def test_bad_templates_are_rejected_and_numbers_are_wild(spark):
    rows = [(f"http://h.xyz/{kind}/{i}", 2 * i + (kind == "spam")) for i in range(60) for kind in ("spam", "news")]
    frame = spark.createDataFrame(rows, "url string, _label_key bigint")
    labels = spark.createDataFrame([(k, k % 2) for _, k in rows], "key bigint, bad int")
    out = {(r["template"], r["verdict"]) for r in url_filters.judged(frame, labels).collect()}
    assert out == {("/spam/#", "block"), ("/news/#", "allow")}
    named = [(f"http://h.xyz/{chr(97 + i % 26)}{chr(97 + i // 26)}q/z", i) for i in range(80)]
    many = spark.createDataFrame(named, "url string, _label_key bigint")
    assert {r["template"] for r in url_filters.judged(many, labels.limit(0)).collect()} == {"/*/z"}


def test_pages_keep_other_columns(spark):
    out = html_extraction.with_main_text(pages(spark))
    assert out.columns == [*pages(spark).columns, "main_text"]
    texts = [r["main_text"] for r in out.collect()]
    assert texts == ["One, two & three four", "", "", "", "<<<", "deep"]


def test_main_text_of_a_page_with_everything_around_it():
    page = """<html><head><title>T</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies, all of them, always, for you, and for us.</p></div>
    <div id="content"><article><h1>Title&nbsp;&eacute;</h1><p>First   paragraph, with
    <a href="x">a link</a>, and more.<p>Second<br>one, long enough, to count, as text.
    <ul><li>item one<li>item two</ul><form><p>Name, please</p></form>
    <div class="share-buttons">Share, share</div></article>
    <section id="comments"><p>Nice, really, very nice, I liked it a lot, so much, indeed, yes.</p></section></div>
    <aside><p>Other, things, to, read, here, and, there, and, so, on.</p></aside><footer>(c)</footer></body></html>"""
    expected = ["Title é", "First paragraph, with a link, and more.", "Second one, long enough, to count, as text."]
    assert html_extraction.extract(page).split("\n") == [*expected, "item one", "item two"]


@pytest.mark.parametrize(
    "attributes, left_out",
    [
        ('class="main-nav"', True),
        ('class="ad-box wide"', True),
        ('id="comments"', True),
        ('class="commentList"', True),
        ('class="related-posts"', True),
        ('class="cookieNotice"', True),
        ('class="entry has-sidebar"', False),
        ('class="post comments-open"', False),
        ('class="main-content"', False),
        ('class="loaded shadow"', False),
        ('class="post-header"', False),
        ('class="site-header"', True),
        ('role="navigation"', True),
        ('style="display: none"', True),
        ("hidden", True),
        ("data-x=1", False),
    ],
)
def test_elements_are_left_out_by_name(attributes, left_out):
    page = f"<body><div><p>Some text, long enough.</p><div {attributes}><p>Other text, as long.</p></div></div></body>"
    assert ("Other" not in html_extraction.extract(page)) == left_out


LONG = "<p>A paragraph, long enough, that goes on, and on, with commas, as the first section of an article does.</p>" * 15
LONG_TEXT = "\n".join(["A paragraph, long enough, that goes on, and on, with commas, as the first section of an article does."] * 15)


@pytest.mark.parametrize(
    "page, expected",
    [
        (  # sections, the second much shorter, and a title in a header
            f"<header>Site</header><article><header><h1>Title</h1></header><section>{LONG}</section>"
            "<section><h2>Second</h2><p>Short.</p></section></article><footer>end</footer>",
            f"Title\n{LONG_TEXT}\nSecond\nShort.",
        ),
        (  # a title beside the container, and link lists without a name
            f"<div><a href=1>one</a> <a href=2>two</a></div><h1>Title</h1><div class='article-body'>{LONG}</div>"
            "<p>Last.</p><ul><li><a href=3>three</a><li><a href=4>four</a></ul>",
            f"Title\n{LONG_TEXT}\nLast.",
        ),
        (  # lists, tables, quotes, code, figures and loose text beside the top section
            f"<main><div><div><section>{LONG}</section><ul><li>item<li>item 2</ul></div>"
            "<table><tr><td>a<td>b</table><blockquote>Quote</blockquote></div><pre>x = 1</pre>"
            "<figure><img src=x><figcaption>Caption</figcaption></figure>Loose, <a href=1>linked</a> text</main>",
            f"{LONG_TEXT}\nitem\nitem 2\na\nb\nQuote\nx = 1\nCaption\nLoose, linked text",
        ),
        (  # articles beside each other
            f"<article>{LONG}</article><article><p>Small, but one, too.</p></article>",
            f"{LONG_TEXT}\nSmall, but one, too.",
        ),
        (  # a page of links around a text keeps the text
            f"<div>{LONG}</div>" + "<div><a href=1>a link that is as long as a line of a text is</a></div>" * 99,
            LONG_TEXT,
        ),
    ],
)
def test_main_text_is_whole(page, expected):
    assert html_extraction.extract(f"<html><head><title>T</title></head><body>{page}</body></html>") == expected


@pytest.mark.parametrize("name", ["sidebar-left", "menu-primary", "ad-top", "nav-main", "widget", "cookie-notice"])
def test_first_words_name_what_is_left_out(name):
    page = f"<body><div><p>Some text, long enough.</p><div class='{name}'><p>Other text, as long.</p></div></div></body>"
    assert html_extraction.extract(page) == "Some text, long enough."


@pytest.mark.parametrize(
    "page, expected",
    [
        (  # a page builder's parts
            "<div class='elementor-element elementor-widget elementor-widget-heading'>"
            "<div class='elementor-widget-container'><h1>Title</h1></div></div>"
            "<div class='elementor-widget elementor-widget-text-editor'>"
            f"<div class='elementor-widget-container'>{LONG}</div></div>"
            "<div class='elementor-widget'><a href=1>one</a><a href=2>two</a></div>",
            f"Title\n{LONG_TEXT}",
        ),
        (f"<div class='widget'><p>{'Prose, and more. ' * 20}</p></div>", ("Prose, and more. " * 20).strip()),
        (f"<div class='sidebar-left'><article>{LONG}</article></div>", LONG_TEXT),  # a layout's name
        ("<div class='comments'><p>Nothing else is here.</p></div>", "Nothing else is here."),
        (f"<div class='nav-main'>{LONG}</div><div><p>Main text, short.</p></div>", "Main text, short."),
    ],
)
def test_names_are_checked_against_the_text(page, expected):
    assert html_extraction.extract(f"<html><body>{page}</body></html>") == expected


@pytest.mark.parametrize(
    "broken",
    [
        lambda n: '<a "' * n,
        lambda n: "<div>" + "</b>" * n,
        lambda n: "<span>" * n + "</b>" * n,
        lambda n: "<b>" * n + "<h1></h1>" * n,
        lambda n: "<ul><li><ul>" + "<span>" * n + "<li></li>" * n,
        lambda n: "<table><tr><td>" * n + "<li></li>" * n,
        lambda n: "<span>" * n + "<p>some words, one after the other</p>" * n,
        lambda n: "<script>" + "</script " * n,
        lambda n: "<a \"'>" * n,
    ],
)
def test_broken_pages_take_time_in_proportion(broken):
    """Four times the page takes some four times as long; what grows with the square would take sixteen times."""

    def seconds(page):
        start = time.perf_counter()
        html_extraction.extract(page)
        return time.perf_counter() - start

    small, large = broken(8_000), broken(32_000)
    assert min(seconds(large) / max(seconds(small), 0.02) for _ in range(3)) < 9


PROSE = "This block holds a good many words, some commas, and more than enough text to be taken for prose by its length alone. " * 2


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<form id=aspnet><h1>Title</h1><div><p>{PROSE}</p></div></form>", ["Title", PROSE.strip()]),
        (f"<form><div><p>{PROSE}</p></div></form>", [PROSE.strip()]),
        (f"<div><h1>Title</h1><p>{PROSE}</p></div><form><p>Your mail, please</p></form>", ["Title", PROSE.strip()]),
        (f"<div class=page-header><h1>Title</h1></div><div><p>{PROSE}</p></div>", ["Title", PROSE.strip()]),
        (f"<article><p>{PROSE}</p></article><div class=discussion><p>I think, {PROSE}</p></div>", [PROSE.strip()]),
        (f"<article><p>{PROSE}</p></article><div class=replies><p>I think, {PROSE}</p></div>", [PROSE.strip()]),
        (f"<div class=notice>We use, {PROSE}</div><article><p>{PROSE}</p></article>", [PROSE.strip()]),
        (f"<div><p>{PROSE}</p></div><div id=ft>(c) us, {PROSE}</div>", [PROSE.strip()]),
        (f'<div><p title="a > b">{PROSE}</p><a href="x>y</a><p>{PROSE}</p></div>', [PROSE.strip(), "y", PROSE.strip()]),
    ],
)
def test_forms_notices_discussions_and_page_headers(page, expected):
    assert html_extraction.extract(f"<html><body>{page}</body></html>").split("\n") == expected


def test_cuts_that_join_across_blocks(spark):
    """Nested items in blocks of their own: each cut joins the next, whatever the order of the blocks."""
    nested = ["a b", "c d", "e f", "g h", "i j", "k l"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(nested)], BENCH)
    inner = "a b"
    for pair in nested[1:]:
        first, last = pair.split()
        inner = f"{first} {inner} {last}"
    docs = spark.createDataFrame([(1, f"x {inner} y", 30), (2, "nothing to cut", 14), (3, inner, 5)], "doc_id bigint, text string, n_chars bigint")
    for block_words in (1, 4, 1000):
        out = {r["doc_id"]: r["text"].split() for r in decontamination.clean_documents(docs, bench, block_words=block_words).collect()}
        assert out == {1: ["x", "y"], 2: ["nothing", "to", "cut"]}
    spans = [decontamination.find_spans(docs, bench, block_words=b).orderBy("doc_id").collect() for b in (1, 1000)]
    assert spans[0] == spans[1]

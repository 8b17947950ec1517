import pytest

from hearthline.llm import extraction as X

PAGE = (
    '<html><head><title>No</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy this now.</div>'
    "<article><h1>A &amp; B</h1><p>First  words<br>go on.<p>Of.</p><script>if (a < b) {}</script><aside>See also</aside></article>"
    '<section class="comments"><p>I read it all and liked it very much indeed.</p></section><footer>&copy; Us</footer>'
)


@pytest.fixture(scope="module")
def tree(spark):
    return X.train(spark)


def test_training_table_is_learnt(spark, tree):
    rows = X.labelled_blocks(spark).collect()
    assert all(tree.verdict(tuple(r)[:-1]) == (r.label == 1.0) for r in rows)


def test_article_alone(tree):
    assert X.main_text(PAGE, tree) == "A & B\n\nFirst words go on.\n\nOf."


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("just words", "just words"), ("<p>open <b>end", "open end"), ("<!-- <p>x</p>", ""),
    ("<article><p>x &lt; y</p></article><div style='display:none'>z</div>", "x < y"),
    ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
])
def test_odd_pages(tree, html, text):
    assert X.main_text(html, tree) == text


def test_table_with_other_columns(spark, tree):
    pages = spark.createDataFrame([(1, PAGE, "t"), (1, PAGE, "t"), (None, None, None)], "page_id long, html string, text string")
    rows = X.extract(pages, tree).collect()
    assert sorted(r.n_chars for r in rows) == [0, 30, 30] and all(r.n_chars == len(r.text) for r in rows)
    assert X.extract(pages.limit(0), tree).count() == 0


TEXT = "Whole article text of the page, long enough to be a paragraph."


@pytest.mark.parametrize("before", [
    '<svg-icon name="x"></svg-icon>', "<button-bar>", "<video-player src='a'></video-player>", '<iframe src="a"/>', "<svg/>",
    '<iframe src="a" /><iframe src="b">none</iframe>', "<button class=x>", "<svg><title>Logo</title><path d='M0'/></svg>", "<SCRIPT>if (a < b) {}</Script >",
])
def test_only_silent_elements_themselves_are_dropped(tree, before):
    assert X.main_text(f"<article>{before}<p>{TEXT}</p></article>", tree) == TEXT


@pytest.mark.parametrize("attrs, kept", [
    ('class="overflow-hidden p-4"', True), ('data-title="hidden gems of the valley"', True), ("class='a hidden b'", True), ("data-hidden=1", True),
    ("hidden", False), ('class="a" hidden', False), ('class="a"hidden', False), ('HIDDEN=""', False), ('style="display: none"', False),
    ('aria-hidden="true"', False),
])
def test_hidden_is_an_attribute(tree, attrs, kept):
    assert X.main_text(f"<article><div {attrs}><p>{TEXT}</p></div></article>", tree) == (TEXT if kept else "")


def test_many_unended_tags_take_no_longer_than_the_page(tree):
    assert X.main_text("<article><p>" + "w <button> " * 50_000 + "</p></article>", tree) == ("w " * 50_000).strip()


def test_script_without_end_takes_the_rest(tree):
    assert X.main_text(f"<article><p>{TEXT}</p><script>var a = '<p>no</p>'", tree) == TEXT


@pytest.mark.parametrize("start, end", [
    ('<article class="post category-legal tag-search">', "</article>"), ('<main class="content share-enabled">', "</main>"),
    ('<div class="main-content sidebar-right">', "</div>"), ('<div id="page" class="related-on">', "</div>"),
    ('<form id="form1" method="post"><div><article>', "</article></div></form>"), ("<form><h1>A head</h1>", "</form>"),
])
def test_layout_names_and_page_wide_forms_keep_the_article(tree, start, end):
    kept = X.main_text(f"<body>{start}<p>{TEXT}</p><p>{TEXT}</p>{end}<footer>Us</footer></body>", tree)
    assert kept.removeprefix("A head\n\n") == f"{TEXT}\n\n{TEXT}"


def test_form_within_an_article_stays_out(tree):
    assert X.main_text(f"<article><p>{TEXT}</p><form><p>{TEXT}</p></form><p>{TEXT}</p></article><h1>x</h1>", tree).count(TEXT) == 2
    assert X.main_text("<article><p>w</p>" + "<form>" * 20_000, tree) == "w"


def test_sidebars_stay_out(tree):
    side = f'<div class="sidebar-right"><p>{TEXT}</p></div><div class="content-sidebar"><p>{TEXT}</p></div>'
    assert X.main_text(f"<main><h1>Head</h1><p>{TEXT}</p></main>{side}", tree).count(TEXT) == 1

import pytest

from purlin.llm.html_extract import extract_main_text, main_text

ARTICLE = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy now.</div><article><h1>Head &amp; more</h1><p><b>First\n  bold<br>line.<p>Short.</p><div class='comments'><p>A reader says</p></div><form><input>Mail</form></article><footer>&copy; x</footer></body></html>"
LONG = "This paragraph is long enough to be the main text of a page that marks nothing at all, as many are."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><nav>only a menu</nav>", ""),
        (ARTICLE, "Head & more\n\nFirst bold line.\n\nShort."),
        (f"<div><a>Home</a></div><p>{LONG}</p><p>{LONG}</p><div class='sidebar'>Side</div><footer>end</footer>", f"{LONG}\n\n{LONG}"),
        ("<article><p>a &lt;b&gt; &#233; &nbsp;x</p></article>", "a <b> é x"),
        ("<article><p>unclosed <i>tag", "unclosed tag"),
        ("<article><p>one</p><!-- never closed <p>two</p>", "one"),
        ("<main><header>Site</header><p>Text in main</p><aside>More</aside></main>", "Text in main"),
        ("<article><ul><li>one<li>two</ul></article>", "one\n\ntwo"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE), (2, None, None), (2, None, None), (3, "v", "<article>" + "<p>w é</p>" * 20_000)], "page_id long, url string, html string")
    got = extract_main_text(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 3).n_chars == 20_000 * 5 - 2
    assert extract_main_text(pages.where("page_id > 9")).collect() == []


@pytest.mark.parametrize("between", ["<div class='related'><p>One</p><p>Two</p><p>Three</p></div>", "<ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul>"])
def test_an_interrupted_text_keeps_all_its_parts(between):
    first, last = f"<p>{LONG}</p><p>{LONG}</p>", f"<p>{LONG}</p>"
    assert main_text(f"<div>{first}{between}{last}</div>") == "\n\n".join([LONG] * 3)


@pytest.mark.parametrize("attrs", ["style='overflow:hidden'", 'data-x="a hidden b"', "class='has-sidebar'", "class='elementor-widget-text'", "id=page class='content no-sidebar'"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_a_wrapper_of_the_whole_text_is_no_zone(attrs, tag):
    inner = f"<p>{LONG}</p><p>{LONG}</p>"
    page = f"<nav>Menu</nav><div {attrs}><{tag}>{inner}</{tag}><div class='sidebar'>Aside</div></div><div class='ad'>Buy</div>"
    assert main_text(page) == f"{LONG}\n\n{LONG}"
    split = "".join(f"<div {attrs}><p>{LONG}</p></div>" for _ in range(3))
    assert main_text(f"<nav>Menu</nav>{split}<div class='ad'>Buy</div>") == "\n\n".join([LONG] * 3)


def test_zones_longer_than_the_text_stay_zones():
    assert main_text(f"<article><p>Short text.</p></article><div class='cookie-notice'><p>{LONG}</p></div>") == "Short text."
    assert main_text(f"<p>{LONG}</p><div class='comments'>{f'<p>{LONG}</p>' * 5}</div>") == LONG
    assert main_text(f"<p>{LONG}</p><div hidden>{f'<p>{LONG}</p>' * 5}</div>") == LONG


LINKS = "".join(f"<li><a>More {i}</a></li>" for i in range(6))
LISTED = [f"More {i}" for i in range(6)]


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        (f"<p>{LONG}</p><ul>{LINKS}</ul><p>Short end.</p>", [LONG, *LISTED, "Short end."]),
        (f"<p>{LONG}</p>{'<p><a>Link</a></p>' * 3}<p>Short end.</p>", [LONG, "Link", "Link", "Link", "Short end."]),
        (f"<p>{LONG}</p><math><mi>x</mi><mo>=</mo><mn>1</mn></math>", [LONG, "x=1"]),
        (f"<p>{LONG}</p><section class='related work'><p>{LONG}</p></section>", [LONG, LONG]),
        (f"<p>{LONG}</p><section class='related'><ul>{LINKS}</ul></section>", [LONG]),
        (f"<p>{LONG}</p><blockquote class='promo-quote'>{LONG}</blockquote><p class='side-note'>{LONG}</p>", [LONG] * 3),
        (f"<header><h1>Head</h1><p>Share this</p></header><p>{LONG}</p>", ["Head", LONG]),
        ("<h1>Head</h1><p>By</p><p>Today</p>" + f"<p>{LONG}</p><ul>{LINKS}</ul><p>Tags</p>", ["Head", "By", "Today", LONG, *LISTED, "Tags"]),
        ("<p><a>One</a></p><p><a>Two</a></p>", ["One", "Two"]),
    ],
)
def test_a_marked_article_keeps_all_its_lines(inside, want):
    assert main_text(f"<nav><a>Menu</a></nav><article>{inside}</article><footer>f</footer>") == "\n\n".join(want)


def made_up_page(rng, marked):
    """A page with what must go and what must stay; and what must stay."""
    blocks, kept = [], []
    for _ in range(rng.randint(4, 12)):
        text = " ".join(rng.choice(["alpha", "beta", "gamma &amp; delta", "épsilon"]) for _ in range(rng.randint(8, 30)))
        shown = text.replace("&amp;", "&")
        kind = rng.choice(["p", "p", "p", "h2", "list", "quote", "split", "nav", "form", "script", "comments", "ad", "aside"])
        if kind in ("p", "h2"):
            blocks.append(f"<{kind} class='c{rng.randint(0, 9)}'>{text}</{kind}>")
            kept.append(shown)
        elif kind == "list":
            blocks.append(f"<ul><li>{text}</li><li>{text}</ul>")
            kept += [shown, shown]
        elif kind == "quote":
            blocks.append(f"<blockquote>{text}\n  <i>{text}</i></blockquote>")
            kept.append(f"{shown} {shown}")
        elif kind == "split":
            blocks.append(f"<div><p>{text}<p>{text}</div>")
            kept += [shown, shown]
        else:
            blocks.append({"nav": f"<nav><ul><li><a>{text}</a></ul></nav>", "form": f"<form><label>{text}</label></form>", "script": f"<script>var a = '<p>{text}</p>';</script>", "comments": f"<div id='comments'><p>{text}</p></div>", "ad": f"<div class='ad'>{text}</div>", "aside": f"<aside>{text}</aside>"}[kind])
    body = "".join(blocks)
    inner = f"<{marked}>{body}</{marked}>" if marked else f"<div>{body}</div>"
    return f"<html><head><title>t</title></head><body><header><a>Home</a></header>{inner}<footer>(c)</footer></body></html>", kept


@pytest.mark.parametrize("marked", ["article", "main", None])
def test_generated_pages_keep_exactly_their_text(marked):
    import random

    rng = random.Random(4)
    for _ in range(300):
        page, kept = made_up_page(rng, marked)
        doubtful = marked is None and ("id='comments'" in page or "class='ad'" in page) and len(kept) < 4  # others may have more text than an unmarked article
        if kept and not doubtful:
            assert main_text(page) == "\n\n".join(kept)


def test_a_mark_on_a_teaser_is_not_believed():
    assert main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>Teaser</p></article>").startswith(f"{LONG}\n\n{LONG}")
    assert main_text(f"<p>{LONG}</p><article><p>{LONG}</p><p>{LONG}</p></article>") == f"{LONG}\n\n{LONG}"


def test_extra_columns_nulls_and_repeated_rows(spark):
    rows = [(1, "u", ARTICLE, "x", 5), (1, "u", ARTICLE, "y", 6), (None, None, None, None, None), (2, "v", "", "z", 1), (3, "w", "<p>" + "long text " * 50_000, "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = extract_main_text(pages).collect()
    assert [f for f in extract_main_text(pages).columns] == ["page_id", "url", "text", "n_chars"] and len(got) == 5
    by = {r.page_id: r for r in got}
    assert by[None].text == by[2].text == "" and by[3].n_chars == 499_999
    assert len({r.text for r in got if r.page_id == 1}) == 1 and extract_main_text(pages.where("false")).collect() == []

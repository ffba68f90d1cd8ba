import pytest

from wearcast.llm.html_text import extract_text, main_text

LONG = "This paragraph is long enough to look like an article, with a lot of words and hardly any tag in it. "


@pytest.mark.parametrize("page, want", [
    ("", ""), ("<", "<"), ("plain  text", "plain text"), ("<!-- open <p>x", ""), ("<script>never", ""),
    ("<article><p>x</article>", "x"), ("<p>a<p>b", "a\nb"), ("</div></p>x</b>", "x"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    (f"<article><h1>T &amp; U</h1><p>{LONG}<b>bold<p>next&nbsp; &eacute;t&#233;</p></article><footer>f</footer>",
     f"T & U\n{LONG}bold\nnext été"),
    (f"<nav><a href=/>Home</a></nav><article><p>{LONG}</p><aside>side</aside><div class='ad-box'>buy</div>"
     f"<script>if (a < b) x('<p>')</script><ul><li>one<li>two</ul></article><section id=comments><p>{LONG * 9}</p></section>",
     f"{LONG.strip()}\none\ntwo"),
    (f"<body><header><h2>Site</h2></header><div class=layout><div class=content><h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
     f"</div><div class=sidebar><p>{LONG}</p></div></div><form><label>n</label></form></body>",
     f"Head\n{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><header><h1>In</h1></header><p style='display:none'>hidden</p><p>{LONG}</p></article>", f"In\n{LONG.strip()}"),
])
def test_main_text(page, want):
    assert main_text(page) == want


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</article>", "c"), (1, "u", f"<article><p>{LONG}</article>", "c"), (None, None, None, "c"),
            (3, "v", "", "c"), (4, "w", f"<article>{'<p>' + LONG + '</p>'}" * 2000 + "</article>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[:4] == [
        (0, 0), (1, len(LONG) - 1), (1, len(LONG) - 1), (3, 0)]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_text(pages.limit(0)).count() == 0


def test_article_of_every_page(spark):
    """On the test pages the article element holds the main text and nothing else."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " " if "br" in b else "", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inner))]
        assert main_text(r["html"]) == "\n".join(b for b in blocks if b)


P = "<p>" + "x" * 49 + " " + "y" * 50 + "</p>"
ONE = "x" * 49 + " " + "y" * 50


@pytest.mark.parametrize("page, want", [
    (f"<main><article>{P * 3}</article><article>{P * 3}</article></main>", [ONE] * 6),
    (f"<main><h1>Title</h1><p>Lead</p><article>{P * 3}</article></main>", ["Title", "Lead"] + [ONE] * 3),
    (f"<main><h1>Title</h1>{P}<article>{P * 3}</article></main><nav><a href=/>Home</a></nav>", ["Title"] + [ONE] * 4),
    (f"<body><article>{P * 3}</article><article><p>Short entry</p></article><article>{P * 3}</article></body>",
     [ONE] * 3 + ["Short entry"] + [ONE] * 3),
    (f"<ul><li><a href=/>Menu</a></ul><div><h1>Title</h1></div><p>Lead</p><article>{P * 3}</article>", ["Title", "Lead"] + [ONE] * 3),
    (f"<div><p>{ONE}</p></div><div><article>{P * 3}</article></div>", [ONE] * 4),
    # What the threshold leaves out stays out.
    (f"<article><h1>Title</h1>{P * 3}</article><div><p>ok</p><ul><li><a href=/>More</a><li><a href=/>Yet more</a></ul></div>",
     ["Title"] + [ONE] * 3),
])
def test_text_outside_the_densest_article(page, want):
    assert main_text(page) == "\n".join(want)


REMARK = f"<section class='comments-area'><p>{LONG * 9}</p></section>"


@pytest.mark.parametrize("page, want", [
    (f"<div class='container no-sidebar'><article>{P * 3}</article></div>", [ONE] * 3),
    (f"<div id='page' class='has-footer'><div>{P * 3}</div></div>", [ONE] * 3),
    (f"<div class='post category-promo'>{P * 3}</div><div class='ad-box'><p>buy</p></div>", [ONE] * 3),
    (f"<div class='promo'><main>{P * 3}</main></div>", [ONE] * 3),
    (f"<div class='widget'>{P * 3}</div><p class='notice'>n</p>", [ONE] * 3),
    (f"<article class='post has-comments'>{P * 3}{REMARK}</article>", [ONE] * 3),
    (f"<article class='post comment-status-open'>{P * 3}</article>{REMARK}", [ONE] * 3),
    (f"<article class='related'>{P * 3}</article>", [ONE] * 3),
    # Furniture still goes, with the articles of teasers and comments in it.
    (f"<article>{P * 3}</article><div class='relatedPosts'><article><p>Teaser</p></article></div>", [ONE] * 3),
    (f"<main><article>{P * 3}</article><ol id=comments><li><article class='comment-body'><p>{LONG * 9}</p></article></ol></main>", [ONE] * 3),
    (f"<div class='wrap'>{P * 3}</div><div class='sidebar left-sidebar'><p>{LONG}</p></div>", [ONE] * 3),
    (f"<div class='wrap'>{P * 3}</div><div id='comments'><p>{LONG * 9}</p></div>", [ONE] * 3),
])
def test_names_of_layout_wrappers(page, want):
    assert main_text(page) == "\n".join(want)


ASIDE = "<form action=/s><label>Name</label><input name=q><p>Sign up for our letters</p><button>Go</button></form>"


@pytest.mark.parametrize("page, want", [
    # A form that wraps the page is no furniture, one beside or inside the article is.
    (f"<form id='aspnetForm'><div class=menu><a href='/'>Home</a></div><div>{P * 3}</div><label>Search</label></form>", [ONE] * 3),
    (f"<form id='aspnetForm'><article><h1>T</h1>{P * 3}{ASIDE}</article></form>", ["T"] + [ONE] * 3),
    (f"<article>{P * 3}{ASIDE}</article>{ASIDE}", [ONE] * 3),
    (f"<div>{P * 3}</div>{ASIDE}", [ONE] * 3),
    ("<form><label>User</label><input><label>Password</label><input><button>Log in</button>or <a href=/r>register</a></form>", []),
    # Ids made from headings, classes about a subject.
    (f"<article>{P}<section id='related-work'><h2>Related work</h2>{P}</section><h2 id='login'>Login</h2>{P}</article>",
     [ONE, "Related work", ONE, "Login", ONE]),
    (f"<article>{P}<section id='navigation'><h2>Navigation</h2>{P}</section><p class='share-price'>Price 5</p></article>",
     [ONE, "Navigation", ONE, "Price 5"]),
    (f"<article>{P * 3}</article><section id='comments'><h2>Comments</h2>{P * 9}</section>", [ONE] * 3),
    (f"<article>{P * 3}</article><section id='related-posts'><h2>Related posts</h2><a href='/a'>One</a><a href='/b'>Two</a></section>",
     [ONE] * 3),
    # Formulas are text; their source notation isn't.
    (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p>{P}</article>", ["Let x=2 be.", ONE]),
    # Quotes delimit only after an equals sign.
    (f"<article><p><a title=Bob's href=/x>Bob</a> and it's fine</p>{P}<p title='a > b'>c</p></article>", ["Bob and it's fine", ONE, "c"]),
    ("<article><p>" + "<a x=\"1\" " * 4000, [("<a x=\"1\" " * 4000).strip()]),
    # A slash doesn't end a script.
    (f"<article>{P}<script src='x'/>alert(1)</script>{P}</article>", [ONE] * 2),
    (f"<article>{P}<svg/>{P}<iframe src='y'/></article>", [ONE] * 2),
])
def test_common_layouts(page, want):
    assert main_text(page) == "\n".join(want)

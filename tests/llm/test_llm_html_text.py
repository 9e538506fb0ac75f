import pytest

from streetlens.llm.html_text import FEATURES, apply, blocks, features, main_text, trained_tree

TREE = trained_tree()


def text_of(page):
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, apply(TREE, features(found)) >= 0.5, strict=True) if keep)


LONG = "a sentence of the article that goes on for quite a while and then some more words follow it until the end of it all"


@pytest.mark.parametrize(("page", "want"), [
    ("<nav><a>Home</a></nav><article><h1>Title</h1><p>One.</p></article><footer>c</footer>", "Title\nOne."),
    ("<body class='has-sidebar'><div id=cookie-notice>We use</div><main><p>A &amp; B&nbsp;&eacute;</p></main>", "A & B é"),
    ("<article><p>x <b>y</b>z\n\t w<br>v</p><script>var a='</p>';</script><style>p{}</style><!-- no --></article>", "x yz w v"),
    ("<article><header><h2>Head</h2></header><p>Text</p><aside>pull</aside><form>mail <button>go</button></form></article>", "Head\nText"),
    ("<article><p>Main</p></article><section class='comments'><article><p>Reader says something</p></article></section>", "Main"),
    ("<article><p>Main</p><div class='advert'>Buy</div><ul><li>a</li><li><a href=x>b</a></li></ul></article>", "Main\na\nb"),
    (f"<ul><li><a>m</a></li><li><a>n</a></li></ul><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><ul><li><a>o</a></li></ul>", "\n".join([LONG] * 3)),
    ("<article><p>never closed <i>at all", "never closed at all"),
    ("<article>5 &lt; 6 < 7<p>a<!-- open", "5 < 6 < 7\na"),
    ("<article><p>A<svg class='icon'/>b</p><math/><iframe src='x'/><p>C</p></article>", "Ab\nC"),
    ("<article><svg viewBox='0'><path d='M0'/><text>no</text></svg><p>A</p></article>", "A"),
    ("<article><div><button>go</div><p>A</p><p>B <select><option>one<option>two</p><p>C</p></article>", "A\nB\nC"),
    ("<article><p>A</p><button><div>go</div></button><p>B</p><select><option>one</option></select></article>", "A\nB"),
    ("<article><p><button>one</p><p>A</p><p><button>two</button>B</p></article>", "A\nB"),
    # names that only contain a mark, or speak of the page around it
    ("<main class='has-sidebar'><p>A</p></main>", "A"), ("<article class='post comments-open'><p>A</p></article>", "A"),
    ("<article class='header-image'><p>A</p></article>", "A"), ("<article><div class='social-science'><p>A</p></div></article>", "A"),
    ("<article><section class='legal-history'><p>A</p></section></article>", "A"), ("<article style='overflow:hidden' data-x='class=ad'><p>A</p></article>", "A"),
    ("<article><p>A</p><div class='ad-slot'>b</div><div id=relatedPosts>c</div><div class='cookie_notice x'>d</div><div aria-hidden='true'>e</div></article>", "A"),
    # marks of any element
    ("<article><p class='ad'>Buy</p><p>A</p><p hidden>b</p><p>B</p><p style='display: none'>c</p><h2 class=x>C</h2></article>", "A\nB\nC"),
    ("<article><p>A <span class='share'>Share <b>this <span>now</span></b></span>b</p><p>B<span class=ad>never closed</p><p>C</p></article>", "A b\nB\nC"),
    ("<article><ul><li class='promo'>Buy<li>A</ul><p>see <a class='share' href=x>tweet</a><a href=y>this</a></p></article>", "A\nsee this"),
    # pages without marks
    (f"<p>Log in to post</p><div><p>{LONG}</p><p>{LONG}</p><p>We use cookies on this site</p><p>{LONG}</p></div><p>Share this</p>", "\n".join([LONG] * 3)),
    ("<article><p>Cookies</p><p>They are baked.</p><p>Share this cake.</p></article>", "Cookies\nThey are baked.\nShare this cake."),
    (f"<article><p>{LONG} cookies</p><p>Read more of cookies in the next part of this</p><p>We use cookies</p><p>{LONG}</p></article>",
     f"{LONG} cookies\nRead more of cookies in the next part of this\nWe use cookies\n{LONG}"),
    (f"<div><p>{LONG} cookies {LONG}</p><p>{LONG}</p><p>{LONG} subscribe</p></div>", f"{LONG} cookies {LONG}\n{LONG}\n{LONG} subscribe"),
    (f"<p>Top of the site here</p><p>Small line</p><div><p>{LONG}</p><p>A short sentence stands between two.</p><p>{LONG}</p></div><p>Last line of all</p><p>And one more</p>",
     f"{LONG}\nA short sentence stands between two.\n{LONG}"),
    ("", ""), ("<nav>only</nav>", ""), ("<article></article>", ""),
])
def test_pages(page, want):
    assert text_of(page) == want


def test_table_of_pages(spark):
    rows = [(1, "u", "<article><p>é 日</p></article>", "x"), (2, None, None, "x"), (1, "u", "<article><p>é 日</p></article>", "x"), (None, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((str(r.row.page_id), r.text, r.n_chars) for r in main_text(pages).collect())
    assert got == [("1", "é 日", 3), ("1", "é 日", 3), ("2", "", 0), ("None", "", 0)]
    assert main_text(pages.limit(0)).count() == 0


def test_very_long_page(spark):
    body = "".join(f"<p>paragraph number {i} of a page</p>" for i in range(40_000))
    page = spark.createDataFrame([(1, "u", f"<nav>n</nav><article>{body}</article><footer>f</footer>")], "page_id bigint, url string, html string")
    assert main_text(page).first().text.count("\n") == 39_999


def test_the_tree_looks_at_words_and_neighbours():
    def splits(tree):
        return set() if len(tree) == 1 else {FEATURES[tree[0]]} | splits(tree[2]) | splits(tree[3])

    assert {"words", "links", "aside"} <= splits(TREE) and splits(TREE) & {"words_before", "words_after", "links_before", "links_after"}

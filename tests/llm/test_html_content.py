import html
import re

import pytest

from hustings.llm import html_content as hc

SF = "/root/testdata/sf0.001"


def article(page):
    """The article of the supplied pages, by its tags alone."""
    body = re.split("</article>|<footer", page.split("<article>", 1)[1])[0].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_query_against_the_markup(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = hc.op10_html_content(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


def test_region_is_found_without_an_article_element(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = hc.learned_weights(pages)
    for r in pages.collect():
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert hc.main_text(plain, weights) == article(r.html)


PARTS = {
    "menu": "<ul class='main-menu'><li><a href=/>Home page</a></li></ul>",
    "header": "<header><h1>Site name</h1></header>",
    "sidebar": "<div id=sidebar><p>Other things to read</p></div>",
    "notice": "<div class='cookie-notice'><p>We keep cookies</p></div>",
    "advert": "<div class='ad'>Buy more of it now</div>",
    "form": "<form><p>Your name please</p><input name=q></form>",
    "script": "<script>if (a < b) document.write('<p>no</p>')</script>",
    "style": "<style>p > a {x: y}</style>",
    "comments": "<section class='comments'><p>What a fine article this is</p></section>",
    "remark": "<!-- <p>not shown</p> -->",
    "hidden": "<div style='display: none'><p>unseen words</p></div>",
}


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("place", ["before", "within", "after"])
@pytest.mark.parametrize("named", [True, False])
def test_clutter_is_left_out(part, place, named):
    said = ["The first paragraph has words &amp; more.", "The <b>sec</b>ond one\n has &#x41;&eacute; as well.", "And a third to end it here."]
    inner = f"<h1>A title</h1><p>{said[0]}</p>" + (PARTS[part] if place == "within" else "") + f"<p>{said[1]}</p><p>{said[2]}</p>"
    if part == "header" and place == "within" and named:
        return  # a header inside of an article is part of it
    wrapped = f"<article>{inner}</article>" if named else f"<div>{inner}</div>"
    page = "<html><body>" + (PARTS[part] if place == "before" else "") + wrapped + (PARTS[part] if place == "after" else "") + "</body></html>"
    assert hc.main_text(page, {}) == "A title\n\nThe first paragraph has words & more.\n\nThe second one has Aé as well.\n\nAnd a third to end it here."


def test_best_region_against_all_regions():
    import random

    rnd = random.Random(5)
    for _ in range(300):
        items = [hc.Tag("li", 0, False) if rnd.random() < 0.5 else hc.Block("w " * rnd.randint(0, 3) + "w", "p", rnd.random() < 0.4, 0) for _ in range(rnd.randint(0, 14))]

        def score(x):
            if isinstance(x, hc.Tag):
                return hc.TAG
            return (x.text.count(" ") + 1) * (hc.CLUTTER if x.clutter else hc.WORD)

        sums = [sum(map(score, items[a:b])) for a in range(len(items)) for b in range(a + 1, len(items) + 1)]
        a, b = hc.best_region(items, {})
        assert sum(map(score, items[a:b])) == max([0, *sums])


def test_odd_pages(spark):
    rows = [
        (1, None, None), (None, "u", ""), (2, "u", "plain words only"), (2, "u", "<p>open <i>and"), (3, "u", "<<<>>> & <3 x</p"),
        (4, "u", "<article><p>" + "long page &lt; " * 300_000), (5, "u", "<div class=ad>only an advert</div>"), (6, "u", "<a <b> <p title='>'>q</p>"),
    ]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url, r.n_chars): r.text for r in hc.extract(df, {}).collect()}
    texts = sorted(got.values(), key=len)
    assert len(got) == 8 and texts[:2] == ["", ""]
    assert got[2, "u", 16] == "plain words only" and got[2, "u", 8] == "open and"
    assert got[4, "u", len(("long page < " * 300_000).strip())].startswith("long page < long")
    assert hc.learned_weights(df.limit(0)) == {}

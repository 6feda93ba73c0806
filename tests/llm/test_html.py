from trailmark.llm import html_text

BODY = "This is a paragraph of the article, with commas, and enough words to count as one. " * 3


def page(inner, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{inner}</body></html>"


def test_article_without_the_rest():
    html = page(
        f"<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=a>A</a></ul></nav><div class='cookie-notice'><p>{BODY}</p></div>"
        f"<main><article><h1>Head &amp; line</h1><p>{BODY}</p><div class=advert><p>{BODY}</p></div><p>Short.</p><form><p>{BODY}</p><input></form></article>"
        f"<aside><p>{BODY}</p></aside></main><section id=comments><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></section><footer>&copy; x</footer>",
        "<style>p{}</style><script>var a='<p>no</p>';</script>",
    )
    assert html_text.extract(html) == "\n\n".join(["Head & line", BODY.strip(), "Short."])


def test_without_semantic_elements_scores_decide():
    links = "".join(f"<li><a href={i}>A long link text number {i}, with a comma, to be discounted</a></li>" for i in range(30))
    html = page(f"<div class=top><ul>{links}</ul></div><div class=wrap><div class=x><p>{BODY}</p><p>{BODY}</p><blockquote>{BODY}</blockquote></div><div class=y><p>Tiny</p></div></div>")
    assert html_text.extract(html) == "\n\n".join([BODY.strip()] * 3)


def test_siblings_of_the_best_container():
    html = page(f"<div id=a><div class=part><p>{BODY}</p><p>{BODY}</p></div><div class=part><p>{BODY}</p></div><p>{BODY}</p></div>")
    assert html_text.extract(html) == "\n\n".join([BODY.strip()] * 4)


def test_white_space_breaks_and_unclosed_tags():
    html = page(f"<article><p><b>One\n  two&nbsp;&#8212;&eacute;<br>three<p>{BODY}<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>")
    assert html_text.extract(html) == "\n\n".join(["One two —é three", BODY.strip(), "a", "b", "c d", "e"])


def test_hidden_and_inline():
    html = page(f"<article><p hidden>{BODY}</p><p style='display: none'>{BODY}</p><p aria-hidden=true>{BODY}</p><p>{BODY}in<i>li</i>ne</p><noscript>n</noscript></article>")
    assert html_text.extract(html) == f"{BODY}inline"


def test_odd_pages():
    assert html_text.extract(None) == "" and html_text.extract("") == "" and html_text.extract("   ") == ""
    assert html_text.extract("plain text, no tags") == "plain text, no tags"
    assert html_text.extract("<p>unclosed <b>bold") == "unclosed bold"
    assert html_text.extract("<script>never ends") == ""
    assert html_text.extract("a < b <p>c</p>").startswith("a < b")
    deep = "<div>" * 5000 + f"<p>{BODY}</p>" + "</div>" * 5000
    assert BODY.strip() in html_text.extract(deep)
    assert html_text.extract(page("<article>" + f"<p>{BODY}</p>" * 4000 + "</article>")).count("\n\n") == 3999


def test_words_of_titles_do_not_drop_text():
    text = BODY.strip()
    parts = f"<h2 id=search-trees>Search trees</h2><p>{BODY}</p><section id=related-work><p>{BODY}</p></section><div id=legal-status><p>{BODY}</p></div><div class=social-history><p>{BODY}</p></div>"
    links = "<div class=related><a href=a>Another story of the same site, with a long title</a> <a href=b>And one more, with a title that is longer still</a></div>"
    form = f"<div class=search><p>{BODY}</p><input></div>"
    html = page(f"<article>{parts}{links}{form}<div class=copyright>All rights reserved.</div><section id=related><p><a href=c>{BODY}</a></p></section></article>")
    assert html_text.extract(html) == "\n\n".join(["Search trees", text, text, text, text])


def test_text_siblings_of_any_tag():
    long = "<p>" + "A sentence with a comma, and so on, and on, and on. " * 40 + "</p>"
    links = "".join(f"<a href={i}>A link with a longer text, number {i}</a> " for i in range(5))
    html = page(f"<div><section>{long * 4}</section><section><p>{BODY}</p></section><div>{links}</div><section>Tiny</section></div>")
    got = html_text.extract(html)
    assert BODY.strip() in got and "A link" not in got and "Tiny" not in got


def test_rows(spark):
    kind = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", page(f"<article><p>{BODY}</p></article>"), "old", 9), (2, None, None, None, None), (2, None, None, None, None), (None, "", "", "", 0)]
    got = html_text.extract_pages(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, BODY.strip(), len(BODY.strip())), (2, "", 0), (2, "", 0)]
    assert html_text.extract_pages(spark.createDataFrame([], kind)).count() == 0


def test_unclosed_raw_parts_do_not_nest():
    for tag in ("svg", "noscript", "canvas", "video"):
        got = html_text.extract(page(f"<article><p>{BODY}</p></article>" + f"<{tag}>" * 100_000 + "<p>after</p>"))
        assert got == BODY.strip()


def test_links_inside_an_article():
    farm = "".join(f"<li><a href={i}>A headline of another story, number {i}</a></li>" for i in range(12))
    notes = "<ul><li>A note with a <a href=x>link</a> and much more text around it</li><li>Another note</li></ul>"
    html = page(f"<main><article><h1>Head</h1><p>{BODY}</p><ul>{farm}</ul>{notes}</article><div><ul>{farm}</ul></div></main>")
    assert html_text.extract(html) == "\n\n".join(["Head", BODY.strip(), "A note with a link and much more text around it", "Another note"])


def test_inline_words_headers_and_threads():
    html = page(
        f"<article><header><h1>Head</h1><p class=byline>By A. Writer</p><p>3 May</p></header><p>{BODY}See <span class=tags>these words</span> too.</p>"
        f"<h2 class=search>Search algorithms</h2><div class=more-info><p>{BODY}</p></div></article><ol class=thread><li><p>{BODY}</p></li><li><p>{BODY}</p></li></ol>"
    )
    assert html_text.extract(html) == "\n\n".join(["Head", f"{BODY}See these words too.", "Search algorithms", BODY.strip()])


def test_pages_against_an_independent_extractor():
    """The test pages' articles by the standard library's parser, without trees or scores."""
    import re
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Articles(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("h1", "p", "article"):
                self.blocks.append([])
            if tag == "br":
                self.blocks[-1].append(" ")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag in ("h1", "p", "article"):
                self.blocks.append([])

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1].append(data)

    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        parser = Articles()
        parser.feed(r["html"] or "")
        blocks = (re.sub(r"\s+", " ", "".join(b)).strip() for b in parser.blocks)
        assert html_text.extract(r["html"]) == "\n\n".join(b for b in blocks if b)

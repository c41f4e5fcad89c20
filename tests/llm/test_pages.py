"""What the host's suffixes remove from pages, with and without marked articles."""

from mailveil.llm import extraction

PASSAGE = " ".join(f"standing{k}" for k in range(14))


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in extraction.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_boilerplate_inside_an_article_goes(spark):
    pages = [(k, f"http://a/{k}", f"<article><p>own words number{k}</p><p>{PASSAGE}</p></article>") for k in range(10)]
    assert texts(spark, pages) == {k: f"own words number{k}" for k in range(10)}


def test_copies_count_as_one_page_and_few_pages_are_no_share(spark):
    own = lambda k: " ".join(f"page{k}word{i}" for i in range(20))
    pages = [(k, f"http://b/{k}", f"<p>{own(0 if k < 5 else k)}</p>") for k in range(15)]
    pages += [(k, f"http://c/{k}", f"<p>{own(k)}</p>" + f"<p>{PASSAGE}</p>" * (k < 22)) for k in range(20, 30)]
    out = texts(spark, pages)
    assert all(out[k] == own(0 if k < 5 else k) for k in range(15))
    assert out[20] == f"{own(20)}\n\n{PASSAGE}" and out[29] == own(29)


def test_names_are_whole_and_wrappers_of_the_article_stay():
    text = lambda page: extraction.blocks(page)[0]
    assert text("<h2 id='related-work'>A</h2><section id='search-methods'>B</section><div class='social-history'>C</div><h3 id='search'>D</h3><p data-id='menu'>E") == ["A", "B", "C", "D", "E"]
    assert text("<div class='layout no-sidebar'><article>A</article></div>") == text("<div class='has-sidebar'><article>A</article></div>") == ["A"]
    assert text("<div class='sidebar'><article>A</article></div>") == text("<form><main>A</main></form>") == ["A"]
    assert text("<div class='sidebar'><article>teaser</article></div><article>A<div class='comments'><article>no</article></div></article>") == ["A"]
    assert text("<div class='ad cookie-banner'>no</div><div id='disqus_thread'>no</div><p class='x share'>no</p>A") == ["A"]


def test_unclosed_furniture_ends_where_html_ends_it():
    text = lambda page: extraction.blocks(page)[0]
    assert text("<p class='notice'>no<p>A<p class='notice'>no<div>B</div>C") == ["A", "B", "C"]
    assert text("<ul><li class='menu'>no<li>A<ul><li class='menu'>no</ul>B</ul>C") == ["A", "B", "C"]
    assert text("<dl><dt class='ad'>no<dd>A<dt>B</dl><table><tr class='ad'><td>no<tr><td class='ad'>no<td>C</table>D") == ["A", "B", "C", "D"]
    assert text("<div><p class='notice'>no</div>A<select><option>no</select><p>B") == ["A", "B"]


def test_formulas_and_fallbacks_of_an_article_are_text():
    page = "<article><p>A <math><mi>x</mi><annotation>no</annotation></math> <canvas>B</canvas> <object>C</object></p><xmp><b> &lt;</xmp></article>"
    assert extraction.blocks(page)[0] == ["A x B C", "<b> &lt;"]

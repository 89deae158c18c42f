import json
import re

import pytest

from cellframe.llm import wrappers as W


def items(page):
    return W.structure(W.read(page))


def wrapper(*pages):
    return W.expression(json.loads(W.merge_all([json.dumps(items(p)) for p in pages])))


def test_inference_makes_optional_repeated_and_text_slots():
    a = "<body><h1>x</h1><p>one</p><p>two</p><div class=note>n</div></body>"
    b = "<body><h1>y</h1><p>one</p><table><tr><td>1</table></body>"
    assert wrapper(a, b) == wrapper(b, a)
    assert wrapper(a) == "<body><h1>#TEXT</h1>(<p>#TEXT</p>)+<div.c:note>#TEXT</div></body>"
    assert wrapper(a, b) == ("<body><h1>#TEXT</h1>(<p>#TEXT</p>)+(<div.c:note>#TEXT</div>)?"
                             "(<table><tr><td>#TEXT</td></tr></table>)?</body>")
    assert wrapper("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl>(<dt>#TEXT</dt><dd>#TEXT</dd>)+</dl>"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script>
</head><body><header class="top">Site</header><nav><ul><li><a href=/a>A</a><li>B</ul></nav><div class="ad">buy</div>
<article><h1>Head &amp; <i>tail</i></h1><p>One&nbsp;&lt;two&gt;
 three<br>line<p>unclosed <b>bold</p><!-- <p>hidden</p> --><ul><li>x<li>y</ul>
<aside>side</aside><div class="share-buttons">share</div><section id="comments"><p>reader says</p></section>
<form><input value="q">ask</form></article><footer>&copy; me</footer></body></html>"""
TEXT = "Head & tail\nOne <two> three\nline\nunclosed bold\nx\ny"


def extracted(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, _host string").repartition(3)
    return {r.page_id: r for r in W.extract_main_text(df).collect()}


@pytest.mark.parametrize("limit", [W.MAX_BROADCAST_BYTES, -1])
def test_pages(spark, monkeypatch, limit):
    monkeypatch.setattr(W, "MAX_BROADCAST_BYTES", limit)
    plain = [f"<html><body><div>Shop of all things</div><div class=body><h2>Title {i}</h2><p>Story {i}</p></div></body>"
             for i in range(4)]
    deep = "<div>" * 3000 + "deep &lt; text" + "</div>" * 3000
    pages = [(0, "http://a.org/1", PAGE), (1, "http://a.org/2", PAGE.replace("<aside>side</aside>", "")),
             (2, None, None), (3, "http://b.org/", ""), (4, None, "only text <b>here"), (5, "http://c.org", deep),
             (6, "http://d.org", "<article><p>" + "long text " * 50_000 + "</p></article>"),
             (7, "http://e.org", "<p>unfinished <a href='x"), (8, "http://a.org/1", PAGE)]
    pages += [(10 + i, f"http://plain.org/{i}", p) for i, p in enumerate(plain)]
    got = extracted(spark, [(*p, "t", "h") for p in pages])
    assert len(got) == len(pages)
    assert got[0].text == got[1].text == got[8].text == TEXT
    assert got[2].text == got[3].text == "" and got[2].url is None
    assert got[4].text == "only text here" and got[5].text == "deep < text"
    assert got[6].text == ("long text " * 50_000).strip()
    assert got[7].text.startswith("unfinished")
    for i in range(4):  # the same words on every page of a host are its template
        assert got[10 + i].text == f"Title {i}\nStory {i}"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_of_one_page_keep_their_text(spark):
    page = "<html><body><div><p>all the same</p></div></body></html>"
    got = extracted(spark, [(i, "http://same.org/", page, None, None) for i in range(5)])
    assert {r.text for r in got.values()} == {"all the same"}


def test_wrappers_do_not_depend_on_partitions(spark):
    pages = [(i, "http://x.org/", "<body>" + "<p>a</p>" * (i % 3) + "<div>b</div>" * (i % 2) + "<table></table>" * (i % 5 == 0))
             for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    one, many = (W.infer(d).collect() for d in (df.coalesce(1), df.repartition(7)))
    assert [r.wrapper for r in one] == [r.wrapper for r in many] and len(one) == 1


def test_empty_table(spark):
    assert W.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_each_page_has_its_own_landmark(spark):
    bodies = ["<nav>menu</nav><article><p>in article</p></article><p>beside</p>", "<nav>menu</nav><main><p>in main</p></main><p>beside</p>",
              "<nav>menu</nav><div><p>plain</p></div>"]
    pages = [(10 * h + i, url, f"<html><body>{b}</body></html>", None, None)
             for h, url in enumerate(["http://mixed.org/", None, "no scheme"]) for i, b in enumerate(bodies)]
    got = extracted(spark, pages)
    for h in range(3):
        assert [got[10 * h + i].text for i in range(3)] == ["in article", "in main", "plain"]


def test_depth_loses_no_text(spark):
    def page(n, close):
        return ("<html><body><p>before</p>" + "<div>" * n + "<article><p>first</p><div><section><p>second</p></section></div>"
                "<nav>menu</nav>third</article>" + "</div>" * close + "<p>after</p></body></html>")

    pages = [(n, f"http://deep{n}.org/", page(n, n), None, None) for n in (5, 97, 98, 99, 100, 101, 150, 3000)]
    plain = "<body><main>" + "<div>" * 120 + "a<ul><li>b</li></ul><nav>menu</nav>c" + "</div>" * 120 + "<p>d</p></main></body>"
    odd = "<body><p>" + "<x-y>" * 20_000 + "e"
    got = extracted(spark, [*pages, (1, "http://e.org/", plain, None, None), (2, "http://f.org/", odd, None, None)])
    for n, *_ in pages:
        assert got[n].text == "first\nsecond\nthird"
    assert got[1].text == "a\nb\nc\nd" and got[2].text == "e"


def test_copies_beside_other_pages_keep_their_text(spark):
    def page(kind, text):
        return f"<html><body><div>Shop of all things</div><div class={kind}><p>{text}</p></div></body></html>"

    pages = [(i, "http://mixed.org/", page("story", "the same story"), None, None) for i in range(4)]
    pages += [(10 + i, "http://mixed.org/", page("post", f"post {i}"), None, None) for i in range(2)]
    pages += [(20 + i, "http://part.org/", page("story" if i < 3 else "post", f"text {i}").replace("</body>", (
        "<section>series</section>" if i < 3 else "") + "</body>"), None, None) for i in range(9)]
    got = extracted(spark, pages)
    assert {got[i].text for i in range(4)} == {"the same story"}  # three distinct pages share the first line
    assert [got[10 + i].text for i in range(2)] == ["post 0", "post 1"]
    for i in range(9):  # the line on a third of the pages is no template
        assert got[20 + i].text == f"text {i}" + ("\nseries" if i < 3 else "")


def _meaningless(i, kind="x"):
    menu = "".join(f"<li><a href=/{j}>Part {j} of {i % 2}</a></li>" for j in range(2 + i % 3))
    return (f"<html><body><div class=k1><div class=k2>Our site</div><ul class=k3>{menu}</ul></div><div class=k4><h2>Title {i}</h2>"
            f"<p>Story {i} with <a href=/s>a link</a> inside.</p><p>More of {i}.</p></div><div class=k5>All rights {kind}</div></body></html>")


def test_wrapper_decides_where_names_and_landmarks_say_nothing(spark):
    pages = [(i, "http://plain.org/", _meaningless(i), None, None) for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, _host string")
    got = {r.page_id: r.text for r in W.extract_main_text(df).collect()}
    want = {i: f"Title {i}\nStory {i} with a link inside.\nMore of {i}." for i in range(8)}
    assert got == want
    true = W.infer(df)
    assert {r.page_id: r.text for r in W.extract(df, true).collect()} == want
    for other in ("[]", json.dumps([["no.such", 0, [["#", 0, []]]]])):
        wrong = true.withColumn("wrapper", W.F.lit(other))
        assert {r.text for r in W.extract(df, wrong).collect()} == {""}


def test_template_text_inside_articles_goes_too(spark):
    page = "<html><body><article><div>Read on in our app</div><p>Story {}</p><ul><li><a>source {}</a></ul></article></body></html>"
    pages = [(i, "http://a.org/", page.format(i, i), None, None) for i in range(5)]
    assert {r.page_id: r.text for r in extracted(spark, pages).values()} == {i: f"Story {i}\nsource {i}" for i in range(5)}


def test_slots_align_with_a_plain_search():
    """Every text of a page is a slot of its host's wrapper, and the same place has the same name on all pages."""
    import random
    rng = random.Random(3)

    def body(depth=0):
        tags = rng.choices(["p", "div", "section", "h2", "ul"], k=rng.randint(1, 4))
        return "".join(f"<{t}>{body(depth + 1) if depth < 2 and rng.random() < 0.5 else rng.randrange(99)}</{t}>" for t in tags)

    for _ in range(30):
        pages = [f"<body>{body()}</body>" for _ in range(4)]
        wrapper = W.merge_all([json.dumps(items(p)) for p in pages])
        known = W.Aligner(wrapper)
        for p in pages:
            assert [str(t) for _, t in known.slots(p)] == [t for t in re.findall(r"\d+", re.sub(r"<[^>]*>", " ", p))]
        assert len({s for s, _ in known.slots(pages[0])}) >= 1

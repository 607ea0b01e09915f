"""Main text of pages."""

import html
import re

from evenkeel.llm import html_extract as H
from evenkeel.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1></header><nav><a href=/x>Menu</a></nav><div id="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>Head &amp; line</h1></header><p>One &lt;two&gt; a < b &nbsp; x<br>three<p>Para <b>bold</b>ly
<a title="a > b" href='x'>link</a>. <ul><li>i1<li>i2</ul><aside>Side</aside><div class="ad-banner">Ad</div><form><input><button>Go</button></form>
<table><tr><td>c1<td>c2</table><pre>  code
 x </pre></article><section class="comments"><article class="comment"><p>Nice!</p></article></section></main>
<div class=sidebar>side</div><footer>&copy; 2020</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, host string").repartition(3)


def test_markup():
    assert H.blocks(H.parse(PAGE)) == ["Head & line", "One <two> a < b x three", "Para boldly link .".replace(" .", "."), "i1", "i2", "c1", "c2", "code x"]


def test_wrapper_is_learned_without_telling_markup(spark):
    page = "<html><body><div><div>My site</div><div><span>Home</span> <span>About</span></div></div><div><h2>{0}</h2><p>{1}</p>{2}</div><div>All rights</div></body></html>"
    rows = [(i, f"http://A.example/{i}", page.format(f"t{i}", f"text {i} &eacute;", "<p>more</p>" * (i % 2))) for i in range(8)]
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}
    for i in range(8):
        assert got[i].split("\n")[:2] == [f"t{i}", f"text {i} é"] and "site" not in got[i] and "rights" not in got[i] and "Home" not in got[i]


def test_copies_of_one_page_keep_their_article(spark):
    page = "<body><nav>n</nav><article><p>same text</p></article></body>"
    rows = [(i, "http://b.example/", page) for i in range(5)]
    assert {r.text for r in H.extract(pages(spark, rows)).collect()} == {"same text"}


def test_edges(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(0, None, None), (1, "", ""), (2, "x", "plain & simple"), (2, "x", "plain & simple"), (None, "http://c/", "<p>a"), (4, "http://c/", "<"), (5, "http://c/", "<a href='x>b"), (6, None, deep), (7, "u", "<p>" + "w " * 50_000)]
    got = H.extract(pages(spark, rows)).collect()
    texts = sorted((str(r.page_id), r.text) for r in got)
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert ("0", "") in texts and texts.count(("2", "plain & simple")) == 2 and ("None", "a") in texts and ("6", "deep") in texts
    assert dict(texts)["7"] == " ".join(["w"] * 50_000)
    assert H.extract(pages(spark, [])).collect() == []


def test_alignment_has_the_most_matches():
    a, b = H.parse("<div><p>1</p><ul><li>2</li></ul><p>3</p></div>"), H.parse("<div><ul><li>x</li><li>y</li></ul><p>z</p></div>")
    matched = H.align(a, b)
    assert sorted(a.tags[n] for n in matched) == ["#root", "div", "li", "p", "ul"]
    assert all(a.tags[n] == b.tags[m] for n, m in matched.items())


def test_all_pages_of_the_table(spark, folder):
    got = {r.page_id: r.text for r in H.extract(table(spark, folder, "pages")).collect()}
    for r in table(spark, folder, "pages").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.DOTALL).group(1).replace("<br>", " ")
        parts = (html.unescape(re.sub(r"<[^>]*>", "", p)) for p in re.split(r"</?(?:p|h1|article|div|ul|li)>", inside))
        assert got[r.page_id] == "\n".join(t for t in (" ".join(p.split()) for p in parts) if t)


def test_near_copies_keep_the_article_they_share(spark):
    page = "<body><div>Menu</div><article><h1>Head</h1><p>first</p><p>second</p><p>date {0}</p></article></body>"
    rows = [(i, "http://d.example/", page.format(i)) for i in range(20)]
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Head\nfirst\nsecond\ndate {i}" for i in range(20)}


def test_copies_of_a_page_count_once(spark):
    page = "<body><div>My site</div><div><p>{0}</p></div></body>"
    rows = [(i, "http://e.example/", page.format("often" if i < 40 else f"text {i}")) for i in range(43)]
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}
    assert got == {i: "often" if i < 40 else f"text {i}" for i in range(43)}
    few = [(i, "http://f.example/", page.format("a" if i else "b")) for i in range(40)]  # two pages tell nothing
    assert {r.text for r in H.extract(pages(spark, few)).collect()} == {"My site\na", "My site\nb"}


def test_all_named_regions_count_and_a_small_one_does_not_bound():
    body = "<p>a long body without any mark</p><p>and more of it</p>"
    assert H.blocks(H.parse(f"<div class='post-date'>May 1</div><div>{body}</div>")) == ["May 1", "a long body without any mark", "and more of it"]
    parts = "".join(f"<div class='text'>part {'x' * i}</div>" for i in range(1, 4))
    assert H.blocks(H.parse(f"<div>Site</div><div>{parts}</div>")) == ["part x", "part xx", "part xxx"]
    assert H.blocks(H.parse("<div>Site</div><article>one</article><p>between</p><article>two, <article>inner</article></article>")) == ["one", "two,", "inner"]
    assert H.blocks(H.parse("<div>Site</div><main>one</main><main>two longer</main>")) == ["one", "two longer"]


MENU = "<html><body><div>{menu}</div><div class='x1'>{ad}</div><div><div><h2>{head}</h2>{paragraphs}</div></div><div>{foot}</div></body></html>"


def varied(i):
    """A page whose menu, advert and footer differ from those of all others, without any telling name."""
    menu = "".join(f"<a href='/{w}'>{w}</a> " for w in (f"m{i}", f"n{i}", "home"))
    paragraphs = "".join(f"<p>paragraph {j} of {i} with some words in it</p>" for j in range(3 + i % 4))
    return MENU.format(menu=menu, ad=f"buy {i} now", head=f"head {i}", paragraphs=paragraphs, foot=f"foot {i}")


def test_varying_menus_at_a_constant_place_are_template(spark):
    rows = [(i, f"http://g.example/{i}", varied(i)) for i in range(30)]
    for markup in (True, False):
        got = {r.page_id: r.text for r in H.extract(pages(spark, rows), markup=markup).collect()}
        for i in range(30):
            assert got[i].split("\n") == [f"head {i}", *[f"paragraph {j} of {i} with some words in it" for j in range(3 + i % 4)]]


def test_slots_against_plain_sums(spark, folder):
    """The sums of every slot, from one page after the other."""
    found = H.wrappers(table(spark, folder, "pages"))
    by_host = {}
    for r in found.rows.collect():
        by_host.setdefault(r.host, {}).setdefault(r.html, r.page_id)
    expected = {}
    for host, different in by_host.items():
        if len(different) < H.SUPPORT:
            continue
        model = H.parse(min(different, key=different.get))
        for page in different:
            tree = H.parse(page)
            inside = [re.sub(r"\s+", " ", p).strip() for p in tree.parts[0] if isinstance(p, str)]
            assert not any(inside)
            for a, b in H.align(tree, model).items():
                slot = expected.setdefault((host, b), [0, 0])
                slot[0] += 1
                slot[1] += bool(model.text(b)) and tree.text(a) == model.text(b)
    got = {(r.host, r.slot): [r.seen, r.same] for r in found.slots.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k][0] - v[0]) < 0.01 and abs(got[k][1] - v[1]) < 0.01 for k, v in expected.items())


def test_wrappers_are_learned_and_give_the_article(spark):
    """Every host of the larger table has template slots, and without the lists of tags and words the learned
    content is the article on at least 95 % of the pages."""
    given = table(spark, "/root/testdata/sf0.1", "pages")
    known = H.wrappers(given).learned.collect()
    assert len(known) >= 50 and all(r.template and r.content for r in known)
    hosts = {r.host for r in known}
    whole = {r.page_id: r.text for r in H.extract(given).collect()}
    alone = {r.page_id: r.text for r in H.extract(given, markup=False).collect()}
    ids = [r.page_id for r in H.wrappers(given).rows.collect() if r.host in hosts]
    assert sum(whole[i] == alone[i] for i in ids) >= 0.95 * len(ids)


def test_very_deep_pages_align(spark):
    deep = "<div>" * 3000 + "{0}<p>{0}</p>" + "</div>" * 3000
    rows = [(i, "http://h.example/", deep.format(f"t{i}") + "<div><i>x</i></div>" * (i % 3)) for i in range(6)]
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}
    assert all(got[i].startswith(f"t{i}\nt{i}") for i in range(6))
    menu = "<nav>" + "<div>" * 300 + "menu" + "</div>" * 300 + "</nav>"
    assert H.blocks(H.parse("<div>" * 300 + menu + "<p>text</p>")) == ["text"]

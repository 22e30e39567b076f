import collections
import html
import pathlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from conftest_data import table
from impactrank.llm import extract as E
from impactrank.llm import htmltree as T
from impactrank.llm.queries import op9_main_text


def article_of(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_query_equals_the_articles(spark, sf_dir):
    pages = {r["page_id"]: r for r in table(sf_dir, "pages")}
    rows = op9_main_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id]["url"], article_of(pages[r.page_id]["html"]), len(r.text))


def test_kinds_of_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>a{}</style></head><body class="has-sidebar"><header class=top><h1>Site</h1></header>
    <div id="nav-menu"><a href=x>Home</a></div><div class="cookie-notice">We use</div><main><h1>Head &amp; tail</h1><!-- <p>no</p> --><p>A &lt; B<br>C&nbsp;d <b>bold</b>e
    <p>two<ul><li>one<li>two <em>x</em></ul><script>if (a < b) { document.write("<p>no</p>") }</script><aside>side</aside><form>f</form>
    <table><tr><td>c1<td>c2</table><div class="ad">buy</div><section id="comments"><p>me too</p></section></main><footer>f</footer>"""
    assert E.main_text(page).split("\n") == ["Head & tail", "A < B C d bolde", "two", "one", "two x", "c1", "c2"]
    assert E.main_text("just text &eacute; <b>x") == "just text é x"
    assert E.main_text("") == E.main_text(None) == E.main_text("<p") == E.main_text("<nav>menu</nav>") == ""
    assert E.main_text("<") == "<" and E.main_text("a < b > c") == "a < b > c"
    assert E.main_text("<div><p>a</div><p>b</p>c<p") == "a\nb\nc"
    assert E.main_text("<p title='a>b'>x</p><p title=\"it's>\">y</p>") == "x\ny"
    assert E.main_text("<p title=it's>x</p><p>y</p>") == "x\ny"  # no quote closes the first
    assert E.main_text("<head><meta charset=x><p>no end of the head</p>") == "no end of the head"
    assert E.main_text("&#" + "9" * 6000 + ";x&#" + "0" * 6000 + "65;") == "�xA"


def test_marked_elements():
    marks = ["side-bar", "siteNotice", "adBox", "ad-slot", "reader-comments", "newsLetter", "cookie_banner", "adsbygoogle", "related-posts"]
    page = "<body><div class='content'><p>kept</p>" + "".join(f"<div class='{m}'><p>gone</p></div>" for m in marks) + "<div class='shadow added'>too</div></div>"
    assert E.main_text(page) == "kept\ntoo"
    assert E.main_text("<form id=f><div class=menu>m</div><p>a page in a form</p></form>") == "m\na page in a form"  # marks never empty a page
    assert E.main_text("<div class='wrap sidebar-left'><article><p>a</p></article><div id=comments><article>c</article></div></div>") == "a"
    assert E.main_text("<p hidden>h</p><p>s</p>") == "s"


def test_all_articles_stay():
    assert E.main_text("<p>x</p><article><p>one</p></article><div>between</div><article><p>two</p><article class=comment>c</article></article>") == "one\ntwo"
    assert E.main_text("<main><p>a</p></main><p>x</p><main><p>b</p></main>") == "a\nb"


def seconds(page):
    began = time.perf_counter()
    found = T.Page(page)
    T.match(found, T.Page("<div><p>x</p></div>"))
    return time.perf_counter() - began


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<div><p>x", "</span>", "<b><article><span></b>", "<ul><li>x", "<a href='", "<a \">", "<!--", "<script>", "&", "<h2>a</h2><p>b</p>", "<table><tr><td>x", "<p class='a"])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    assert seconds(page) < 40 and seconds(page[: len(page) // 8]) < 10


def test_deep_nesting():
    deep = "<div>" * 100_000 + "<p>text</p>" + "</div>" * 100_000
    assert E.main_text(deep) == "text"
    page = T.Page(deep)
    assert T.match(page, page)[0] == len(page.labels) > 100_000
    assert T.match(page, T.Page(deep.replace("<p>", "<p class=x>")))[0] == 100_001


def test_long_page():
    assert len(E.main_text("<article>" + "<p>para</p>" * 20_000 + "</article>").split("\n")) == 20_000
    assert len(T.Page("<article>" + "<h2>a</h2><p>para</p>" * 20_000 + "</article>").labels) < 12


def grown(draw, n):
    """A random tree of n nodes, numbered as they come in preorder."""
    labels, parents = ["#"], [-1]
    for i in range(1, n):
        parents.append(draw.randrange(max(0, i - 4), i))
        labels.append(draw.choice("abc"))
    return T.Tree(labels, parents)


def plainly(a, b):
    """The size of the best match, by trying for every pair of siblings what follows from taking or leaving it."""
    below_a, below_b = a.children(), b.children()

    def trees(x, y):
        return 1 + forests(tuple(below_a[x]), tuple(below_b[y])) if a.labels[x] == b.labels[y] else 0

    def forests(xs, ys):
        if not xs or not ys:
            return 0
        both = trees(xs[0], ys[0])
        return max(forests(xs[1:], ys), forests(xs, ys[1:]), both + forests(xs[1:], ys[1:]) if both else 0)

    return trees(0, 0)


def test_tree_matching_is_the_largest():
    draw = random.Random(5)
    for _ in range(300):
        a, b = grown(draw, draw.randrange(1, 11)), grown(draw, draw.randrange(1, 11))
        size, partner = T.match(a, b)
        assert size == plainly(a, b) == len(partner)
        for y, x in partner.items():
            assert a.labels[x] == b.labels[y] and (y == 0) == (x == 0) and (not y or partner[b.parents[y]] == a.parents[x])
        order = sorted(partner.items())
        for y, x in order:
            for v, u in order:
                if y < v and b.parents[y] == b.parents[v]:
                    assert x < u
    assert T.match(T.Tree(["r"], [-1]), T.Tree(["r", "p"], [-1, 0]))[0] == 1


def plain_wrapper(pages):
    """The wrapper of one host with one layout, counted page by page."""
    seen, own = {}, []
    for text in pages:
        page = T.Page(text)
        codes = [T.code_of(t) for t in page.texts]
        longest = sorted(range(len(codes)), key=lambda i: (-len(page.texts[i]), i))[: max(3, len(codes) // 4)]
        seen.setdefault(T.code_of(" ".join(str(codes[i]) for i in longest)), (page, codes))
    pivot = seen[min(seen)][0]
    for page, codes in seen.values():
        partner = T.match(pivot, page)[1]
        own.append({(partner[n], c) for n, c in zip(page.nodes, codes) if n in partner})
    held = collections.Counter(x for found in own for x in found)
    slots, constant = set(), set()
    for node in {n for n, _ in held}:
        counts = [k for (n, _), k in held.items() if n == node]
        if sum(any(n == node for n, _ in found) for found in own) < E.PAGES:
            continue
        if sum(k for k in counts if k > 1) >= E.RECUR * sum(counts):
            slots.add(node)
        else:
            at = sum(any(n == node for n, _ in found) for found in own)
            constant |= {(n, c) for (n, c), k in held.items() if n == node and k >= E.AGREE * at}
    return slots, constant


def made_pages(n, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    for i in range(n):
        body = "".join(f"<p>{' '.join(word() for _ in range(12))}</p>" for _ in range(draw.randrange(1, 6)))
        extra = "<ul><li>x</li></ul>" if i % 3 == 0 else ""
        yield f"<body><div><span>Welcome to our site</span></div><div>{draw.choice(['buy this', 'buy that', 'buy more'])}</div>{extra}<div class='x'><p>Said every day</p>{body}</div><div>All rights kept</div>"


def test_wrapper_equals_a_plain_count(spark):
    pages = list(made_pages(60, 3))
    frame = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    found = [r for r in E.wrappers(frame).collect() if r.main]
    layouts = collections.Counter(T.Page(p).layout() for p in pages)
    for r in E.wrappers(frame).collect():
        slots, constant = plain_wrapper([p for p in pages if T.Page(p).layout() == r.layout])
        assert set(r.slots) == slots and set(zip(r.nodes, r.codes)) == constant and slots and constant
    assert len(found) == 1 and found[0].layout == max((n, layout) for layout, n in layouts.items())[1]


def test_the_wrapper_goes_and_content_stays(spark):
    """Blocks that no mark gives away are dropped where they come back on the pages of a host; equal pages count once; each layout has its wrapper."""
    shell = "<body><div><span>Welcome to our site</span></div><div class='x'><p>{}</p><p>{}</p></div><div>All rights kept</div></body>"
    other = "<body><section><b>Shop of the site</b></section><section class='y'><p>ware {}</p></section><section>Prices in euro</section></body>"
    pages = [(i, f"http://h.example/{i}", shell.format(f"text {i}", f"more of it {i}"), 0, 0) for i in range(12)]
    pages += [(50 + i, f"http://h.example/shop/{i}", other.format(i), 0, 0) for i in range(6)]
    pages += [(100 + i, "http://few.example/", shell.format("a", "b"), 0, 0) for i in range(20)]
    pages += [(200, None, None, 0, 0), (201, "odd", "", 0, 0), (None, "http://h.example/n", shell.format("n", "m"), 0, 0), (202, "http://h.example/e", shell.format("", ""), 0, 0)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host long, pivot long")
    got = {r.page_id: r.text for r in E.extract_text(frame).collect()}
    assert got[3] == "text 3\nmore of it 3" and got[None] == "n\nm" and got[202] == "" and got[52] == "ware 2"
    assert got[105] == "Welcome to our site\na\nb\nAll rights kept"
    assert got[200] == got[201] == "" and len(got) == 12 + 6 + 20 + 4
    assert E.extract_text(frame.limit(0)).count() == 0


def test_wrappers_alone_find_the_articles_of_large_hosts(spark):
    """Without tags and class names, and with the shell cut anew from divs, the wrapper of a host tells shell and article apart."""
    pages = list(enumerate(made_pages(700, 9)))
    frame = spark.createDataFrame([(i, "http://h.example/", p) for i, p in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in E.extract_text(frame, hints=False).collect()}
    for i, page in pages:
        assert got[i].split("\n") == re.findall("<p>([a-h ]+)</p>", page)
    parts = E._parts(frame.withColumn("host", E.host_of(F.col("url")))).collect()
    assert [r.parts for r in parts] == [3]


def test_wrappers_alone_decide_the_given_pages(spark, sf_dir):
    """Without a look at tags or class names all pages are their article; without wrappers, none is. Fifty pages show none: shells come from one of 60."""
    sf_dir = pathlib.Path(sf_dir).with_name("sf0.01")
    pages = {r["page_id"]: r["html"] for r in table(sf_dir, "pages")}
    got = {r.page_id: r.text for r in E.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), hints=False).collect()}
    assert got == {i: article_of(page) for i, page in pages.items()}
    assert not any(E.main_text(page, hints=False) == article_of(page) for page in pages.values())


THEME = "<body><div class='t'><span>{menu}</span><em>x</em></div><div class='b'><b>by {host}</b></div><section class='s'><h2>{head}</h2><p>{one}</p></section><section class='z'><dl><dt>{foot}</dt></dl></section></body>"


def themed(n, seed, hosts):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    for i in range(n):
        host = f"h{draw.randrange(hosts)}.example.org"
        head, one = word(), f"{word()} {word()}"
        page = THEME.format(menu=f"menu {i % 7}", host=host, head=head, one=one, foot=f"all rights {i % 3}")
        yield i, f"http://www.{host}/{i}", page, f"{head}\n{one}"


def test_hosts_of_one_theme_share_a_wrapper(spark):
    """One page a host at most times: what recurs over hosts goes, the host's own name too; a tree that hosts share by chance takes nothing."""
    pages = list(themed(120, 4, 100))
    bland = [(1000 + i, f"http://p{i}.example.net/", f"<body><p>said by all {i % 2}</p><div>own {i}</div></body>") for i in range(40)]
    frame = spark.createDataFrame([p[:3] for p in pages] + bland, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in E.extract_text(frame, hints=False).collect()}
    assert all(got[i] == text for i, _, _, text in pages)
    assert got[1003] == "said by all 1\nown 3"


def test_shared_wrappers_equal_a_plain_count(spark):
    pages = list(themed(90, 6, 30))
    frame = spark.createDataFrame([p[:3] for p in pages] * 2, "page_id long, url string, html string").withColumn("host", E.host_of(F.col("url"))).withColumn("part", F.lit(0))
    (found,) = E.shared_wrappers(E.outlines(frame)).collect()
    held, at = collections.Counter(), collections.Counter()
    for _, url, text, _ in pages:
        page = T.Page(text)
        own = set(zip(page.nodes, E.codes_of(page, url.split("/")[2])))
        held.update(own)
        at.update({n for n, _ in own})
        assert page.shape() == found["shape"]
    back = lambda n: sum(k for (m, _), k in held.items() if m == n and k > 1) / sum(k for (m, _), k in held.items() if m == n)
    assert set(found.slots) == {n for n in at if back(n) >= E.RECUR} and found.slots
    assert set(zip(found.nodes, found.codes)) == {(n, c) for (n, c), k in held.items() if n not in found.slots and k >= E.AGREE * at[n]}


def test_a_wrapper_is_the_same_beside_other_hosts(spark):
    """A layout of 2 % of a large host loses an advert of a long rotation as it does alone; other hosts change no wrapper."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    rare = [("h.example.org", f"<body><main><div>buy ware {i % 20}</div><p>{word()} {word()}</p></main><i>x</i></body>") for i in range(100)]
    common = [("h.example.org", f"<body><section><h2>{word()}</h2><p>{word()} {word()}</p></section></body>") for i in range(1900)]
    others = [(f"o{i % 50}.example.org", f"<body><div><h2>{word()}</h2></div></body>") for i in range(500)]
    layout = T.Page(rare[0][1]).layout()

    def wrapper(pages):
        rows = E.wrappers(spark.createDataFrame(pages, "host string, html string")).where(F.col("host") == "h.example.org").where(F.col("layout") == layout).collect()
        return [(r.labels, sorted(r.slots), sorted(zip(r.nodes, r.codes))) for r in rows]

    alone = wrapper(rare)
    assert len(alone) == 1 and alone[0][1]
    assert wrapper(rare + common) == wrapper(rare + common + others) == alone

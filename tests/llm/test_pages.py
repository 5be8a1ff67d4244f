import random
from html.parser import HTMLParser

import numpy as np
import pytest

from vexel.llm import html_extract as hx
from vexel.llm import url_filter as uf

PAGES = "page_id long, url string, html string, text int, host string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], PAGES)


def by_hand(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest)] + [rest.find(c) for c in "/?#" if c in rest])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    inside = lambda h: host == h or host.endswith("." + h)
    fits = [r for r in uf.RULES if inside(r[1]) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    if best:
        return host, path, best[1] + best[2], best[0]
    return host, path, None, "block" if host and any(inside(k) for k in listed) else "allow"


def urls():
    r = random.Random(1)
    out = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "http://example.com#x/en/", "http://example.com?/en/", "x://y://z/en/", "http://notexample.com/en/7", "http://com/en/", "http://É.example.net/de/8", "http://example.net:80/de/8"]
    for _ in range(400):
        name = r.choice(["", "www.", "a.b."]) + r.choice(["spam", "site", "x1", "q"]) + str(r.randint(0, 60))
        out.append(f"http{r.choice(['', 's'])}://{name}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.randint(0, 99)}{r.choice(['', '?a=/b', '#top'])}")
    return out


@pytest.mark.parametrize("bound", [uf.MAX_BITS, 256])
def test_verdicts_are_exact(spark, bound):
    listed = [f"spam{i}.example.{e}" for i in range(60) for e in ("com", "org")] + ["q7.example.net", "absent.example.com"]
    rows = [(i, u, "") for i, u in enumerate([*urls(), "http://spam1.example.com/" + "x" * 200_000, "http://" + "a." * 50_000 + "spam2.example.com/"])] + [(None, "http://spam3.example.com/", "")]
    df = uf.filter_urls(pages(spark, rows), spark.createDataFrame([(k,) for k in listed], "key string"), max_bits=bound)
    got = {r.page_id: tuple(r)[1:] for r in df.collect()}
    assert got == {i: by_hand(u, listed) for i, u, _ in rows}
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_level_one_grows_with_the_ratio_of_others_to_listed():
    assert uf.first_bits(100, 100) == uf.first_bits(1, 0) == uf.BITS_PER_KEY
    assert 100 * 0.6185 ** uf.first_bits(1000, 10**9) <= 1000 / 10**9 * 100


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) as key")
    held = universe.where("crc32(key) % 7 = 0")
    levels = uf.build_cascade(universe, held, bits_per_key=2)
    assert len(levels) > 2
    inside = universe.where(uf.member(universe["key"], levels))
    assert inside.exceptAll(held).count() == 0 and held.exceptAll(inside).count() == 0


def test_no_urls_or_no_list(spark):
    none = spark.createDataFrame([], "key string")
    assert uf.filter_urls(pages(spark, []), uf.default_list(spark)).count() == 0
    rows = uf.filter_urls(pages(spark, [(1, "http://a.example.fr/", ""), (1, "http://a.example.fr/", "")]), none).collect()
    assert [r.verdict for r in rows] == ["allow", "allow"]


@pytest.fixture(scope="module")
def trees():
    return hx.train(400)


def test_trees_find_main_text_in_unseen_layouts(trees):
    r, right, total = random.Random(77), 0, 0
    for _ in range(150):
        nodes = hx.parse(hx.training_page(r))
        texts = [hx.block_text(n) for n in nodes]
        kept, want = hx.decode(nodes, trees.log_odds(hx.features(nodes, texts))), hx.labels_of(nodes) > 0
        has = np.array([bool(t) for t in texts])
        right, total = right + (kept[has] == want[has]).sum(), total + has.sum()
        for i in range(1, len(nodes)):
            assert not kept[i] or kept[nodes[i].up]
    assert right / total > 0.99


class Marked(HTMLParser):
    """The words inside data-main="1" and outside data-main="0", by another parser."""

    def __init__(self):
        super().__init__()
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in hx.VOID:
            return
        if tag in hx.BLOCKS and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")
        mark = dict(attrs).get("data-main")
        self.open.append((tag, mark if mark is not None else self.open[-1][1] if self.open else "0"))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][1] == "1":
            self.words += data.split()


def test_main_text_equals_that_of_another_parser(trees):
    r, same, pages_ = random.Random(78), 0, 120
    for _ in range(pages_):
        page = hx.training_page(r)
        nodes = hx.parse(page)
        texts = [hx.block_text(n) for n in nodes]
        marked = Marked()
        marked.feed(page)
        wanted = [w for t, y in zip(texts, hx.labels_of(nodes)) if y for w in t.split()]
        assert "".join(wanted) == "".join(marked.words)
        same += "".join(hx.main_text(nodes, texts, trees.log_odds(hx.features(nodes, texts))).split()) == "".join(marked.words)
    assert same / pages_ > 0.9


def test_decoding_is_the_best_monotone_choice():
    r = random.Random(4)
    for _ in range(60):
        nodes = [hx.Node("html", "", -1, 0, [], [])]
        for i in range(1, 9):
            up = r.randrange(i)
            nodes.append(hx.Node("p", "", up, nodes[up].depth + 1, [], []))
            nodes[up].kids.append(i)
        odds = np.array([r.uniform(-3, 3) for _ in nodes])
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        value = lambda k: sum(yes[i] if k[i] else no[i] for i in range(1, 9))
        choices = ([True] + [bool(b >> i & 1) for i in range(8)] for b in range(256))
        best = max(value(k) for k in choices if all(not k[i] or k[nodes[i].up] for i in range(1, 9)))
        assert value(hx.decode(nodes, odds)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First
   line &eacute;&#33; <b>bold<br>after</b><p>Second <a href="x>y">link</a>.<script>var x="</p>";</script><ul><li>one<li>two</ul>
<div class="ad-box">Buy now</div><p>Third paragraph.</p></article><section id="comments"><p>Nice post!</p></section><footer>&copy; us</footer></body></html>"""


def test_a_page(trees):
    assert hx.extract_all([PAGE.replace("bold<br>", "<math><mi>b</mi></math><label>o</label><noscript><i>l</i></noscript><object>d</object><br>")], trees) == hx.extract_all([PAGE], trees)
    assert hx.extract_all([PAGE], trees) == ["A & B\nFirst line é! bold after\nSecond link.\none\ntwo\nThird paragraph."]


def test_odd_pages(spark, trees):
    long = "<article>" + "<p>some words here, and more.</p>" * 5000 + "</article>"
    odd = [None, "", "   ", "<", "<a", "<p", "text only", "<div" * 50, "</div></p></article>", "<script>never closed", "<!-- never closed", "<p>a</p>" * 3, "<table><tr><td>x<td>y</table>", "<div>" * 3000, long, PAGE, PAGE]
    out = {}
    for r in hx.extract(pages(spark, [(i, None, h) for i, h in enumerate(odd)]), trees).collect():
        out[r.page_id] = r
    assert len(out) == len(odd) and all(out[i].n_chars == len(out[i].text) for i in out)
    assert out[0].text == out[1].text == "" and out[15].text == out[16].text != ""
    assert out[14].text.count("\n") == 4999
    assert hx.extract(pages(spark, []), trees).count() == 0

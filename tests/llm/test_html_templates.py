"""Site templates: counts against plain Python, and pages on which no article may be lost."""

import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np

from loomwork.llm import html

VOIDS = {"br", "hr", "img"}


class Plain(HTMLParser):
    """A tree of [tag, class, children] of well-formed markup."""

    def __init__(self, page):
        super().__init__()
        self.open = [["html", "", []]]
        self.feed(page)
        self.root = self.open[0]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class", ""), []]
        self.open[-1][2].append(node)
        if tag not in VOIDS:
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def form(node):
    kinds = []
    for c in node[2]:
        if isinstance(c, list) and c[0] not in ("a", "b") and form(c) not in kinds:
            kinds.append(form(c))
    return (node[0], masked(node[1]), tuple(kinds))


def masked(name):
    return re.sub("[0-9]", "", name)


def frozen(node):
    return (node[0], node[1], tuple(frozen(c) if isinstance(c, list) else c for c in node[2]))


def words(node):
    return [w for c in node[2] for w in (words(c) if isinstance(c, list) else c.split())]


def brute_text(host, pages):
    """Blocks of the article of each page: outside it nothing stays here, as all boxes recur; inside, exact repeats go."""
    trees = {i: Plain(p).root for i, p in pages}
    find = lambda n, tag: n if n[0] == tag else next((x for c in n[2] if isinstance(c, list) and (x := find(c, tag))), None)
    articles = {i: find(t, "article") for i, t in trees.items()}
    distinct = {frozen(a): i for i, a in sorted(articles.items(), reverse=True)}
    outer, inner = defaultdict(set), defaultdict(set)

    def walk(node, path, inside, page):
        path = (*path, (node[0], masked(node[1])))
        for c in node[2]:
            if not isinstance(c, list) or c[0] in ("a", "b"):
                continue
            if inside:
                inner[frozen(c)].add(page)
            elif c[0] in ("div", "nav", "footer"):
                outer[path, form(c)].add(page)
            walk(c, path, inside or c[0] == "article", page)

    for i in distinct.values():
        walk(trees[i], (), False, i)
    out = {}
    for i, tree in trees.items():
        text = []
        most = sum(len(w) for w in words(articles[i]))

        def show(node, path, inside):
            path = (*path, (node[0], masked(node[1])))
            for c in node[2]:
                if isinstance(c, str):
                    text.extend(c.split())
                elif inside and c[0] == "p" and len(inner[frozen(c)]) >= max(10, len(distinct) / 2) and sum(map(len, c[2][0:1])) >= 30 and 2 * len("".join(words(c))) <= most:
                    continue
                elif not inside and c[0] in ("div", "nav", "footer") and len(outer[path, form(c)]) >= max(3, len(distinct) / 2):
                    continue
                else:
                    show(c, path, inside or c[0] == "article")

        show(tree, (), False)
        out[i] = " ".join(text)
    return out


def test_templates_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    rows, want = [], {}
    for h, (n, everywhere) in enumerate([(40, 1.0), (25, 0.6), (12, 0.3), (2, 1.0)]):
        host, line, pages = f"h{h}.example", say(12), []
        for i in range(n):
            menu = "".join(f"<li><a href='/{k}'>{say(1)}</a></li>" for k in range(int(rng.integers(2, 7))))
            box = f"<div class='zq{h}'>{say(5)}</div>" if rng.random() < everywhere else ""
            rare = f"<div class='only'>{say(4)}</div>" if i == 1 else ""
            parts = [f"<p>{say(int(rng.integers(5, 30)))}</p>" for _ in range(4)] + ([f"<p>{line}</p>"] if rng.random() < everywhere else [])
            pages.append((100 * h + i, f"<body><div class='top{i}'><ul>{menu}</ul></div>{box}{rare}<article><h1>{say(4)}</h1>{''.join(parts)}</article></body>"))
        pages += [(100 * h + 90 + k, pages[0][1].replace("class='top0'", "class='top7'")) for k in range(8)]  # one article, many addresses
        want |= brute_text(host, pages)
        rows += [(i, f"https://{host}/{i}", p) for i, p in pages]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), counts=True).collect()}
    for i, text in want.items():
        assert got[i].text == text, i
    assert sum(r.n_template for r in got.values()) > 100 and sum(r.n_named for r in got.values()) == 0


def test_repeated_articles_stay(spark):
    page = "<body><div class=\"content\"><p>The whole of the article stands here, three times on one host.</p></div></body>"
    other = "<body><div class='top'>{}</div><article><p>An article under many addresses, with other menus.</p><p>And more of it here.</p></article></body>"
    rows = [(i, "https://one.example/", page) for i in range(3)] + [(10 + i, f"https://two.example/{i}", other.format(f"menu {i}")) for i in range(20)]
    rows += [(40 + i, f"https://three.example/{i}", f"<body><div id='c'><p>First {i} of a text in paragraphs.</p><p>Second {i} one.</p></div><div class='x'>see also {i}</div><h1>Title {i}</h1></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith("The whole of the article") for i in range(3))
    assert all(got[10 + i].endswith("An article under many addresses, with other menus. And more of it here.") for i in range(20))
    assert all(got[40 + i] == f"First {i} of a text in paragraphs. Second {i} one. Title {i}" for i in range(6))


def test_parts_of_articles_stay():
    page = "<article><svg/><div class='social-studies'>a</div><div class='side'>b</div><p class='search'>c</p><label>d</label><div class='comments'>no</div><aside>no</aside></article><div class='ad'>no</div>"
    assert html.main_text(page) == "a b c d"
    assert html.main_text("<p>a <svg><title>x</title></svg> b") == "a b"


def test_odd_markup_costs_in_proportion():
    pages = ["<div>" * 16_000 + "</b>" * 100_000, "<article>" * 16_000, "<p><table>" + "<b>" * 16_000 + "<hr>" * 16_000, "<article>" + "<header>" * 16_000 + "<h1>"]
    for page in pages:
        began = time.process_time()
        assert html.main_text(page + "x") == "x" or "header" in page
        assert time.process_time() - began < 3


def test_joined_templates_give_the_same(spark, monkeypatch):
    rows = [(i, f"https://h{i % 2}.example/{i}", f"<nav>m{i}</nav><div class='k'>n{i}</div><article>t{i}</article>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = sorted(html.extract(df, counts=True).collect())
    monkeypatch.setattr(html, "SMALL", 0)
    assert sorted(html.extract(df, counts=True).collect()) == first and first[3].text == "t3" and first[3].n_template == 2


def say(i, n):
    """Words of a page that come nowhere else."""
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k % 6]}" for k in range(n))


def test_teasers_are_no_article(spark):
    card = "<article class='card'><a href='/{0}'>{1}</a><p>{2}</p></article>"
    rows = []
    for i in range(12):
        cards = "".join(card.format(k, say(40 + i * 3 + k, 4), say(80 + i * 3 + k, 5)) for k in range(3))
        rows.append((i, f"https://t.example/{i}", f"<body><nav><a href='/'>home</a></nav><div class='post-body'><h1>{say(i, 3)}</h1><p>{say(i, 80)}</p><p>{say(i + 20, 80)}</p></div><div class='more'>{cards}</div></body>"))
    rows += [(100 + i, f"https://one.example/{i}", f"<div class='post-body'><p>{say(i, 120)}</p></div><article class='card'><a href='/x'>{say(i + 50, 9)}</a> go</article>") for i in range(8)]
    rows += [(200 + i, f"https://forum.example/{i}", f"<h1>{say(i, 4)}</h1><article><p>{say(i, 30)}</p></article><article><p>{say(i + 30, 20)}</p></article><div class='stats'>{i} seen</div>") for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{say(i, 3)} {say(i, 80)} {say(i + 20, 80)}" for i in range(12))
    assert all(got[100 + i] == say(i, 120) for i in range(8))
    assert all(got[200 + i] == f"{say(i, 4)} {say(i, 30)} {say(i + 30, 20)}" for i in range(8))


def test_blocks_beside_the_longest_stay_if_their_words_differ(spark):
    rows = []
    for i in range(20):
        menu = "".join(f"<a href='/{k}'>{say(60 + i, k + 2)}</a>" for k in range(4))  # its words change from page to page
        ad = f"<div class='zz'>{say(200 + i // 4, 6)}</div>"  # one of five
        rows.append((i, f"https://u.example/{i}", f"<body><div class='m'>{menu}</div><div class='intro'><p>{say(i, 15)}</p></div><div class='text'><p>{say(i + 26, 100)}</p></div>{ad}<div class='outro'>{say(i + 52, 20)}</div></body>"))
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), counts=True).collect()}
    assert all(got[i].text == f"{say(i, 15)} {say(i + 26, 100)} {say(i + 52, 20)}" for i in range(20))
    assert all(r.n_template == 2 and r.n_named == 0 for r in got.values())

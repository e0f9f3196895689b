import re
from html import unescape

from sparkrec.llm import htmlmain
from sparkrec.llm.q_html import op2_html_extraction


def plain_article(html):
    """Article of the test pages, by hand: h1 and p blocks between the article tags."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", html or "", re.S)
    if not m:
        return ""
    inner = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"<[^>]*\Z", "", m[1])))
    parts = [" ".join(unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_query_equals_hand_extraction(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op2_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], plain_article(pages[r["page_id"]]["html"]), len(r["text"]))


def page(body):
    return f'<html><head><title>T</title><style>p{{}}</style></head><body><header><a href="/">Home</a></header><nav><ul><li>menu</ul></nav>{body}<footer>foot</footer></body></html>'


GOOD = "A long enough paragraph of running text, with commas, for the page's own score. " * 3


def test_classes_boilerplate_and_consensus(spark, tables):
    long_ad = '<div class="box7"><p>' + "Buy now and pay later, everyone does. " * 40 + "</p></div>"
    rows = [
        (1, "http://A.example/x", page(f'<div class="post-12 content"><h1>Title &amp; more</h1><p>{GOOD}<p>Two&nbsp;&nbsp;words<br>here<script>var a="</p>"</script></div>')),
        (2, "http://a.example/y", page(f'<div class="content post-7"><p>{GOOD}</p><form><p>Your name</p></form><div class="comments"><p>First!</p></div><div id="cookie-notice"><p>We use cookies</p></div></div>')),
        (3, "http://user@a.example:80/z", page(f'<div class="post-3 content"><p>Short.</p></div>{long_ad}')),
        (4, "http://b.example/", page(f"{long_ad}")),
        (5, None, None), (6, "nowhere", ""), (7, "http://c.example", "plain text without any tag &lt;b&gt;"), (8, "http://d.example", "<p>cut off <b>here &am"),
        (9, "http://d.example", "<div><p>kept</p><!-- gone --><aside>no</aside></div><p"), (9, "http://d.example", "<div><p>kept</p><!-- gone --><aside>no</aside></div><p"),
        (None, "http://d.example", '<table><tr><td>cell one<td>cell "two"</table><a title="x > y">link text</a>'),
    ]
    path = tables(pages=("page_id long, url string, html string, text string, host string, paths int", [(*r, "x", "y", 1) for r in rows]))
    got = {}
    for r in op2_html_extraction(spark, path).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    good = " ".join(GOOD.split())
    assert got[1] == [f"Title & more\n{good}\nTwo words here"]
    assert got[2] == [good]
    assert got[3] == ["Short."]
    assert got[4] == [" ".join(("Buy now and pay later, everyone does. " * 40).split())]
    assert got[5] == [""] and got[6] == [""]
    assert got[7] == ["plain text without any tag <b>"]
    assert got[8] == ["cut off here &am"]
    assert got[9] == ["kept", "kept"]
    assert len(got[None]) == 1


def test_empty_table(spark, tables):
    assert op2_html_extraction(spark, tables(pages=("page_id long, url string, html string", []))).collect() == []


def test_very_long_and_broken_markup():
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    assert htmlmain.extract(deep, []) == "deep text"
    assert htmlmain.extract('<p title="unclosed>text', []) == htmlmain.extract('<p title="unclosed>text', ["/p"])
    assert htmlmain.extract("<" * 50_000, []) is not None
    assert htmlmain.extract("<p>a < b and c > d</p>", []) == "a < b and c > d"


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in htmlmain.main_text(df).collect()}


def test_teaser_on_the_majority_path_does_not_stand_for_the_article(spark):
    good = " ".join(GOOD.split())
    rows = [(i, "http://m.example/a", page(f'<div class="content"><p>Majority {i}. {GOOD}</p></div>')) for i in range(6)]
    rows += [(i, "http://m.example/b", page(f'<div class="content"><p>Intro.</p></div><div class="theme"><p>Other {i}. {GOOD}{GOOD}</p></div>')) for i in range(10, 13)]
    # themes 0 to 8 (digits are generalised, so letters) have two pages each: more voted paths than any bound a host had
    for n, c in enumerate("abcdefghi"):
        rows += [(100 + 2 * n + k, "http://t.example/", page(f'<div class="z{c}"><p>Theme {c}{k}. {GOOD}</p></div><div class="za zx"><p>Line.</p></div>')) for k in range(2)]
    got = texts(spark, rows)
    assert all(got[i] == f"Majority {i}. {good}" for i in range(6))
    assert all(got[i].endswith(f"Other {i}. {good} {good}") for i in range(10, 13))
    assert all(got[100 + 2 * n + k].startswith(f"Theme {c}{k}. {good}") for n, c in enumerate("abcdefghi") for k in range(2))


def test_title_lead_and_sections_beside_the_best_container_stay(spark):
    good = " ".join(GOOD.split())
    body = f'<div class="body"><p>{GOOD}</p><p>{GOOD}</p></div>'
    rows = [(i, "http://n.example/", page(f'<article><h1>Title {i}</h1><p>The lead.</p>{body}<section><p>A note.</p></section></article><p>Outside</p>')) for i in range(3)]
    rows += [(i, "http://o.example/", page(f'<div class="wrap"><div class="story"><h1>Title {i}</h1><p>The lead.</p><div class="w-1/2 body"><p>{GOOD}</p></div></div><div class="more">{"<a href=x>Another story of ours</a>" * 9}</div></div>')) for i in range(10, 13)]
    got = texts(spark, rows)
    assert all(got[i] == f"Title {i}\nThe lead.\n{good}\n{good}\nA note." for i in range(3))
    assert all(got[i] == f"Title {i}\nThe lead.\n{good}" for i in range(10, 13))


def test_only_boilerplate_goes(spark):
    links = '<a href="x">one more story</a> ' * 5
    body = (f'<article><h1 id="related-work">Heading</h1><p>{GOOD}</p><section id="discussion"><h2 id=legal>Discussion</h2><p>We discuss.</p></section><p class="legal">A law.</p>'
            '<div class="notice-period"><p>Three months.</p></div><figure><img src="x"><figcaption>A caption</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p>'
            '<noscript><p>Without script.</p></noscript><div data-id="menu" title="a class=menu"><p>Data names.</p></div><section id="history-of-the-banner"><p>Banners.</p></section>'
            f'<div class="related"><p>{links}</p></div><div class="discussion"><p>Say it</p><textarea></textarea></div><div class="social">{links}</div><div class="menu">Menu</div></article>')
    got = texts(spark, [(i, "http://p.example/", page(body)) for i in range(2)])
    good = " ".join(GOOD.split())
    assert got[0] == got[1] == "\n".join(["Heading", good, "Discussion", "We discuss.", "A law.", "Three months.", "A caption", "So x=2.", "Without script.", "Data names.", "Banners."])


def test_comments_go_wherever_they_stand(spark):
    good = " ".join(GOOD.split())
    comments = ['<section id="comments"><h2>3 comments</h2><p>Great post</p></section>', '<div class="responses"><p>Great post</p></div>', '<ol class="comment-list"><li>Great post</ol>',
                '<section class="replies"><article class="comment"><p>Great post</p></article></section>', '<div id="disqus_thread"><p>Great post</p></div>', '<div id="respond"><p>Leave a word</p></div>',
                '<article class="comment-body" id="comment-12"><p>Great post</p></article>']
    kept = '<section id="comments-on-the-proof"><p>A remark.</p></section><p id="reply-to-critics">An answer.</p>'
    rows = [(i, f"http://q{i}.example/", page(f"<article><h1>Title</h1><p>{GOOD}</p>{kept}{c}</article>{c}")) for i, c in enumerate(comments)]
    got = texts(spark, rows)
    assert all(got[i] == f"Title\n{good}\nA remark.\nAn answer." for i in range(len(comments)))


def test_headers_of_an_article_keep_its_title(spark):
    good = " ".join(GOOD.split())
    heads = ['<div class="entry-header"><h1>Title</h1></div>', "<header><h1>Title</h1></header>", '<div class="entry-header"><div class="inner"><h2>Title</h2></div></div>']
    rows = [(i, f"http://r{i}.example/", page(f'<article>{h}<div class="banner-image"><p>A caption</p></div><div class="site-header"><p>Site line</p></div><p>{GOOD}</p><div class="banner"><p>Buy</p></div></article>')) for i, h in enumerate(heads)]
    rows.append((9, "http://s.example/", page(f'<div class="post">{heads[0]}<p>{GOOD}</p></div>')))
    rows.append((10, "http://t.example/", page(f'<div class="masthead"><h1>The Daily</h1></div><div class="story"><p>{GOOD}</p></div>')))
    got = texts(spark, rows)
    assert all(got[i] == f"Title\nA caption\n{good}" for i in range(3)) and got[9] == f"Title\n{good}" and got[10] == good


def test_deep_and_mismatched_markup_is_linear():
    import time
    import tracemalloc

    hostile = {
        "deep": "<div>" * 40_000 + "deep text",
        "text at each level": "<div>x" * 40_000,
        "unmatched ends": "<i>" * 12_000 + "</b>" * 50_000 + "end",
        "inline chain": "<i>" * 30_000 + "a<p>b" * 10_000,
        "behind a scope": "<p><table>" + "<i>" * 12_000 + "<hr>" * 25_000 + "end",
        "soft names": '<div class="related">' * 9_000 + "related words",
        "links": "<a href=x>" * 20_000 + "word",
    }
    for name, html in hostile.items():
        began = time.process_time()
        assert htmlmain.extract(html, []) or name == "links"
        assert time.process_time() - began < 5, name  # under a second on an idle machine
        tracemalloc.start()
        htmlmain.extract(html, [])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100_000_000, (name, peak)


# ---- an independent, slow version of scoring, voting and widening, on well-formed pages

def slow_blocks(element, path, container, out, inside):
    path = f"{path}/{element.tag}" + "".join(f".{c}" for c in sorted(element.get("class", "").split()))
    if element.tag in ("div", "article", "section", "main", "body"):
        container = path
    links = sum(len(" ".join("".join(a.itertext()).split())) for a in element.findall("a"))
    if element.tag == "p":
        out.append((container, path, " ".join("".join(element.itertext()).split()), links))
    for child in element:
        if child.tag != "a":
            slow_blocks(child, path, container, out, inside)


def slow_scores(found):
    scores = {}
    for container, _, text, linked in found:
        worth = max(0, len(text) - 2 * linked)
        scores[container] = scores.get(container, 0) + worth
        up = container.rsplit("/", 1)[0]
        scores[up] = scores.get(up, 0) + worth / 2
    good = {"article", "content", "main", "post", "entry", "story", "body", "text"}
    return {p: s * (1.5 if set(re.split(r"[^a-zA-Z]+", p.rsplit("/", 1)[1])) & good else 1) for p, s in scores.items() if s > 0 and p}


def slow_widened(found, path):
    steps = path.split("/")
    for tag in ("article", "main"):
        for i in reversed(range(1, len(steps))):
            if steps[i].split(".")[0] == tag:
                return "/".join(steps[:i + 1])
    held_path, at = path, path
    while at.rsplit("/", 1)[0]:
        at = at.rsplit("/", 1)[0]
        inner = [(len(t), k) for c, _, t, k in found if (c + "/").startswith(held_path + "/")]
        outer = [(len(t), k) for c, _, t, k in found if (c + "/").startswith(at + "/")]
        start = [(len(t), k) for c, _, t, k in found if (c + "/").startswith(path + "/")]
        added = sum(n for n, _ in outer) - sum(n for n, _ in inner)
        if added and (added >= sum(n for n, _ in inner) or sum(k for _, k in outer) - sum(k for _, k in start) > 0.2 * added):
            break
        if added:
            held_path = at
    return held_path


def slow_texts(rows):
    import math
    import xml.etree.ElementTree as ET

    parsed, votes = {}, {}
    for i, url, html in rows:
        found = []
        slow_blocks(ET.fromstring(html).find("body"), "/html", "/html", found, False)
        scores = slow_scores(found)
        best = max(scores, key=lambda p: (scores[p], p.count("/"))) if scores else None
        parsed[i] = (url, found, scores, best)
        votes[url, best] = votes.get((url, best), 0) + 1
    out = {}
    for i, (url, found, scores, best) in parsed.items():
        weight = {p: s * math.sqrt(votes.get((url, p), 0) - (p == best)) for p, s in scores.items() if votes.get((url, p), 0) - (p == best) > 0}
        path = max(weight, key=lambda p: (weight[p], p.count("/"))) if weight else best
        wide = slow_widened(found, path) if path else None
        out[i] = "\n".join(t for _, own, t, _ in found if (own + "/").startswith(wide + "/")) if wide else ""
    return out


def random_page(rnd):
    words = "one two three four five six seven eight nine ten eleven twelve".split()

    def element(depth):
        kind = rnd.choice(["p", "p", "p", "div", "section", "article"] if depth < 5 else ["p"])
        if kind == "p":
            inner = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))
            if rnd.random() < 0.3:
                inner += f' <a href="x">{" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))}</a>'
            return f"<p>{inner}</p>"
        name = rnd.choice(["", ' class="wide"', ' class="text"', ' class="b a"', ' class="inner"'])
        return f"<{kind}{name}>{''.join(element(depth + 1) for _ in range(rnd.randint(1, 4)))}</{kind}>"

    return f"<html><head/><body>{''.join(element(1) for _ in range(rnd.randint(1, 4)))}</body></html>".replace("<head/>", "")


def test_votes_and_widening_equal_the_slow_version(spark):
    import random

    rnd = random.Random(21)
    rows = []
    for i in range(240):
        html = random_page(rnd)
        rows += [(len(rows) + k, f"http://h{i % 12}.example/", html) for k in range(rnd.choice([1, 1, 1, 2]))]
    got, want = texts(spark, rows), slow_texts([(i, u.split("/")[2], h) for i, u, h in rows])
    assert got == want
    assert len({len(t) for t in want.values()}) > 100

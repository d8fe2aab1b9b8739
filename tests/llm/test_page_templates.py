"""Templates of pages that have a main element: every subtree is hashed and counted there too."""

from __future__ import annotations

import random
from collections import Counter

from spectrion.llm import html_extract


def extracted(spark, pages, **how):
    df = spark.createDataFrame([(i, f"http://{h}/{i}", html) for i, (h, html) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_templates) for r in html_extract.extract(df, **how).collect()}
    return [got[i] for i in range(len(pages))]


def test_subtrees_of_pages_with_an_article_are_hashed():
    html = '<head><title>t</title></head><body><nav><ul><li>a<li>b</ul></nav><div class="ad">buy</div><article><h1>s</h1><p>x</p></article><p>beside</p><script>v()</script></body>'
    trees = html_extract.Page(html).trees()
    assert len(trees) == 8  # title, two items, list, nav, advert, paragraph and script; not the article nor what is in or around it
    assert trees and set(trees) == set(html_extract.Page(html.replace("<p>x</p>", "<p>y</p>")).trees())
    assert len(set(trees) - set(html_extract.Page(html.replace("v()", "w()")).trees())) == 1


def test_recurring_articles_beside_the_story_go(spark):
    page = '<body><nav><a>home</a><a>news</a></nav><article><h2>Join our club</h2></article><article><h1>Story number {0}</h1><ul><li>one</li></ul><p>again</p></article><footer>f{0}</footer></body>'
    got = extracted(spark, [("h.org", page.format(i)) for i in range(9)])
    assert got == [(f"Story number {i}\none\nagain", 2) for i in range(9)]
    few = extracted(spark, [("h.org", page.format(i)) for i in range(4)])
    assert few == [(f"Join our club\nStory number {i}\none\nagain", 0) for i in range(4)]
    copies = [("h.org", f"<body><p>{i}</p><article>one story</article><article>t{i}</article></body>") for i in range(9)]
    assert extracted(spark, copies) == [(f"one story\nt{i}", 0) for i in range(9)]


def test_pages_with_an_article_tell_the_templates_of_those_without(spark):
    box = "<div><p>Subscribe now</p></div>"
    pages = [("h.org", f"<body>{box}<article>story {i}</article></body>") for i in range(6)] + [("h.org", f"<body>{box}<p>lonely {i}</p></body>") for i in range(2)]
    assert extracted(spark, pages) == [(f"story {i}", 1) for i in range(6)] + [(f"lonely {i}", 1) for i in range(2)]
    rare = [("h.org", f"<body><article>story {i}</article></body>") for i in range(80)] + [("h.org", f"<body>{box}<p>lonely {i}</p></body>") for i in range(6)]
    assert extracted(spark, rare)[80:] == [(f"lonely {i}", 1) for i in range(6)]


def test_templates_equal_brute_force_on_all_kinds_of_pages(spark):
    """Pages are parts side by side: one story at most, furniture by its element or name, and others."""
    r = random.Random(7)
    forms = {"nav": "<nav>{}</nav>", "ad": '<div class="ad">{}</div>', "p": "<p>{}</p>", "section": "<section>{}</section>", "script": "<script>{}</script>"}
    pages = []
    for i in range(300):
        parts = [(k, f"{k} {r.randrange(2) if r.random() < 0.4 else 1000 + 10 * i + j}") for j in range(r.randrange(1, 7)) for k in [r.choice(list(forms))]]
        if r.random() < 0.7:
            parts.insert(r.randrange(len(parts) + 1), ("article", f"story {i if r.random() < 0.9 else 0}"))
        pages.append((f"h{min(r.randrange(5), 2)}.org", parts))
    html = [(h, "<body>" + "".join(forms.get(k, "<article><p>p 1</p>{}</article>").format(x) for k, x in parts) + "</body>") for h, parts in pages]

    def kept(parts, gone=frozenset()):
        story = [x for k, x in parts if k == "article"]
        if story:
            return f"p 1\n{story[0]}"
        for kinds in (("p", "section"), ("p", "section", "ad")):  # adverts only if there is nothing else
            found = [x for k, x in parts if k in kinds and (k, x) not in gone]
            if found:
                return "\n".join(found)
        return ""

    on, every = {}, {}
    for h, parts in pages:
        plain = all(k != "article" for k, _ in parts)
        every.setdefault(h, set()).add((plain, kept(parts)))
        for part in parts:
            on.setdefault((h, part), set()).add((plain, kept(parts)))
    share = lambda some, of: len(some) >= max(5, 0.1 * len(of))
    flat = lambda some: {x for x in some if x[0]}
    gone = {(h, part) for (h, part), where in on.items() if part[0] != "article" and (share(where, every[h]) or share(flat(where), flat(every[h])))}
    want = []
    for h, parts in pages:
        mine = {p for p in parts if (h, p) in gone}
        want.append((kept(parts, mine), sum(p in mine for p in parts)))
    assert extracted(spark, html) == want
    assert {k for _, (k, _) in gone} == set(forms) and Counter(n > 0 for _, n in want)[True] > 50


def test_what_recurs_beside_the_story_in_a_main_element_goes(spark):
    page = "<body><main><article><h2>Join our club</h2></article><p>Subscribe now</p><article><h1>Story number {0}</h1><p>again</p></article><p>note {0}</p></main></body>"
    assert extracted(spark, [("h.org", page.format(i)) for i in range(9)]) == [(f"Story number {i}\nagain\nnote {i}", 2) for i in range(9)]
    assert extracted(spark, [("h.org", page.format(i)) for i in range(4)]) == [(f"Join our club\nSubscribe now\nStory number {i}\nagain\nnote {i}", 0) for i in range(4)]
    only = "<body><main><h1>Story number {0}</h1><p>again</p></main></body>"
    assert extracted(spark, [("h.org", only.format(i)) for i in range(9)]) == [(f"Story number {i}\nagain", 0) for i in range(9)]
    prose = "<body><main><p>Story number {0}</p><p>again and again</p><article>card</article><article>other</article></main></body>"
    assert extracted(spark, [("h.org", prose.format(i)) for i in range(9)]) == [(f"Story number {i}\nagain and again\ncard\nother", 0) for i in range(9)]

"""Decontamination against brute force over short, merged and shared templates; markup that never closes; tables on the way."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spectrion.llm import common, decontamination, html_extract

CAPITAL = re.compile(r"[A-Z][^A-Z]")


def words_of(text):
    """(word, template, slot, opens its line, closes its line) of each word of an ASCII text."""
    out = []
    for line in (text or "").split("\n"):
        found = [(m[0], m.start(), m.end()) for m in re.finditer(r"\d+(?:[.,]\d+)*[A-Za-z]*|[A-Za-z0-9]+", line)]
        for i, (w, a, _) in enumerate(found):
            before = line[found[i - 1][2] : a] if i else "\n"
            number = w[0].isdigit()
            unit = i > 0 and found[i - 1][0][0].isdigit() and w.lower() in decontamination.UNITS
            name = bool(CAPITAL.match(w)) and w.lower() not in decontamination.NO_NAMES and not re.search(r"[.!?:\n]", before)
            kind = "<n>" if number else "<u>" if unit else "<name>" if name else w.lower()
            out.append((w.lower(), kind, kind.startswith("<"), i == 0, i == len(found) - 1))
    return out


def brute_leaks(texts, items):
    """{(doc, item): certain} by the rules of the docstring, window by window."""
    size = decontamination.WINDOW
    docs = {d: words_of(t) for d, t in texts.items()}
    found = {}
    for raw in (False, True):
        classes = defaultdict(list)
        for i, t in items.items():
            w = words_of(t)
            seen = {}
            pattern = tuple(seen.setdefault(x[0], len(seen)) if x[2] else -1 for x in w)
            if w:
                classes[(tuple(x[0] for x in w),) if raw else (tuple(x[1] for x in w), pattern)].append(i)
        for key, members in classes.items():
            item = words_of(items[members[0]])
            k = min(size, len(item))
            wins = []
            for a in range(len(item) - k + 1):
                shape = tuple(x[0] if raw else x[1] for x in item[a : a + k])
                literal = sum(not x[2] for x in item[a : a + k])
                holders = sum(any(tuple(x[0] if raw else x[1] for x in w[b : b + k]) == shape for b in range(len(w) - k + 1)) for w in docs.values())
                if raw or literal >= min(4, k) or holders <= 4**literal * max(1, len(docs) / 16384):
                    wins.append((a, shape))
            for d, w in docs.items():
                lines = defaultdict(list)
                for n, (a, shape) in enumerate(wins):
                    for b in range(len(w) - k + 1):
                        if tuple(x[0] if raw else x[1] for x in w[b : b + k]) == shape:
                            lines[b - a].append((n, a, b))
                spans = [[m] for m in lines]
                spans += [[m for m in lines if m // len(item) == q] for q in {m // len(item) for m in lines}]
                spans += [[m for m in lines if int((m / len(item) + 0.5) // 1) == q] for q in {int((m / len(item) + 0.5) // 1) for m in lines}]
                for span in spans:
                    hits = [h for m in span for h in lines[m]]
                    at = {n for n, _, _ in hits}
                    run = max((len(r) for m in span for r in re.findall("1+", "".join("01"[n in {h[0] for h in lines[m]}] for n in range(len(wins))))), default=0)
                    pairs = set() if raw else {(item[a + j][0], w[b + j][0]) for _, a, b in hits for j in range(k) if item[a + j][2]}
                    agree = min(len({p for p, _ in pairs}), len({q for _, q in pairs})) / len(pairs) if pairs else 1.0
                    if (len(at) >= 0.5 * len(wins) or run >= 6) and agree >= 0.8:
                        sure = len(item) >= 4 or any(w[b][3] and w[b + k - 1][4] for _, _, b in hits)
                        found[d, min(members)] = found.get((d, min(members)), False) or sure
    return found


ITEMS = {
    0: "What is 12 times 7?",
    1: "Maria has 3 cats while Peter owns 5 dogs and they live in the old house by the river",
    2: "Paris",
    3: "What is 99 times 4?",
    4: "the answer is 42",
    5: "a sum of 3 plus 3 is asked for in this small question about adding",
    6: "",
    7: "12 13 14 15 16 17 18 19 20",
    8: "A tank holds 30 liters and loses 2 liters each hour so how long until it is empty",
}
TEXTS = {
    0: "so tell me What is 15 times 9? ok",
    1: "We know Joana has 8 cats while Hugo owns 8 dogs and they live in the old house by the river",
    2: "We know Joana has 8 cats while Hugo owns 4 dogs and they live in the old house by the river",
    3: "They flew to Paris in spring",
    4: "a heading\nParis\nand more",
    5: "maria has 3 cats while peter owns 5 dogs and they live in the old house by the river",
    6: "a sum of 4 plus 9 is asked for in this small question about adding",
    7: "a sum of 4 plus 4 is asked for in this small question about adding",
    8: "they say A tank holds 75 liters and loses 6 liters every single hour so how long until it is empty",
    9: None,
    10: "1 2 3 4 5 6 7 8 9 10 11",
    11: "so here the answer is 43 today",
    12: "WHAT IS 12 TIMES 7",
}


def test_leaks_by_brute_force(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert {k: r.certain for k, r in got.items()} == brute_leaks(TEXTS, ITEMS)
    # re-parameterised though short, by class; values that fall together don't agree; a word in a text isn't certain, as a line it is
    assert (0, 0) in got and got[0, 0].n_items == 2 and (1, 1) not in got and (2, 1) in got and (5, 1) in got
    assert not got[3, 2].certain and got[4, 2].certain and (6, 5) not in got and (7, 5) in got


def test_random_leaks_by_brute_force(spark):
    pick = random.Random(4)
    vocabulary = ["tree", "house", "has", "and", "the", "a", "so", "3", "7", "kg", "12", "Anna", "Ben", "river", "sees"]
    made = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    items = {i: made(pick.choice([2, 4, 5, 8, 10, 14])) for i in range(12)}
    texts = {}
    for d in range(40):
        core = items[pick.randrange(12)].split()
        changed = [pick.choice(["4", "9", "3"]) if w.isdigit() and pick.random() < 0.7 else w for w in core]
        if pick.random() < 0.3:
            changed.insert(pick.randrange(len(changed)), "well")
        texts[d] = f"{made(5)}{pick.choice([' ', chr(10)])}{' '.join(changed)}{pick.choice(['. ', chr(10)])}{made(4)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.certain for r in decontamination.leaks(docs, bench).collect()}
    assert got == brute_leaks(texts, items) and len(got) > 20


def test_common_forms_and_shared_templates(spark):
    items = [(i, f"What is {i + 10} times {i + 3}?") for i in range(300)] + [(300 + i, f"{i} {i + 1} {i + 2} {i + 3}") for i in range(5)]
    texts = [(i, f"number {i} here. What is {i} times {i + 2}? 5 6 7 8") for i in range(60)] + [(60 + i, "5 6 7 8 and 9 10 11 12") for i in range(200)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    got = decontamination.leaks(docs, bench).where("item_id < 300").groupBy("item_id").agg(F.count("*").alias("n"), F.max("n_items").alias("items")).collect()
    # one class for all items of a template, and verbatim pairs besides
    assert max((r.n, r["items"]) for r in got) == (60, 300)
    # four numbers in a row are common, so only verbatim ones are found
    assert decontamination.leaks(docs, bench).where("item_id >= 300 AND n_items > 1").count() == 0
    same = spark.createDataFrame([(1, "What is 15 times 9?")] * 500, "doc_id long, text string")
    assert decontamination.leaks(same, bench).where("n_items = 300").count() == 1


def test_stage_leaves_texts_that_merely_hold_a_word(spark, tmp_path):
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").withColumns({"doc": F.lit(1), "doc2": F.lit("x"), "own": F.lit(2)})
    kept = decontamination.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(TEXTS) - {d for (d, _), sure in brute_leaks(TEXTS, ITEMS).items() if sure} >= {1, 3, 6, 9}


# Markup


def slow_parse(html):
    """The tree's texts by scanning the whole stack for each closing tag."""
    return html_extract.Page(html).text()


@pytest.mark.parametrize("html", ["<b>" * 200_000 + "</i>" * 200_000, "<p><table>" + "<b>" * 150_000 + "</p>" * 150_000, "<noscript>" * 150_000, "<![CDATA[" * 150_000 + ">", "<!" * 400_000, "<b>" * 100_000 + "<script></b>" * 100_000, "<td>" * 200_000, "<li><b>" * 150_000])
def test_markup_that_never_closes_takes_linear_time(html):
    began = time.time()
    html_extract.parse(html)
    assert time.time() - began < 10


def scan_tree(html):
    """What the parser did before: the stack is scanned for each tag."""
    H = html_extract
    root = H.Node("")
    stack, hidden = [root], 0
    for m in re.finditer(r"<(/?)([a-z]+)>|([^<]+)", html):
        if m[3]:
            if not hidden:
                stack[-1].children.append(m[3])
            continue
        name = m[2]
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    hidden -= sum(n.dropped for n in stack[i:])
                    del stack[i:]
                    break
                if name == "p" and stack[i].name in H.SCOPE:
                    break
            continue
        closes = H.CLOSES.get(name, ())
        if name in H.CLOSES_P or closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closes or stack[i].name == "p" and name in H.CLOSES_P:
                    hidden -= sum(n.dropped for n in stack[i:])
                    del stack[i:]
                    break
                if stack[i].name in H.SCOPE:
                    break
        node = H.Node(name, name in H.FURNITURE)
        if not hidden:
            stack[-1].children.append(node)
        if name not in H.VOID:
            stack.append(node)
            hidden += node.dropped
    return root


def shape(node):
    return node if isinstance(node, str) else (node.name, [shape(c) for c in node.children])


def test_parser_equals_a_scan_of_the_stack():
    pick = random.Random(6)
    names = ["p", "div", "b", "li", "ul", "td", "tr", "table", "nav", "dd", "dt", "br", "article", "option"]
    for _ in range(3000):
        html = "".join(pick.choice([f"<{pick.choice(names)}>", f"</{pick.choice(names)}>", pick.choice("xyz")]) for _ in range(pick.randrange(30)))
        a, b = html_extract.parse(html), scan_tree(html)
        join = lambda n: re.sub(r"', '", "", str(shape(n)))  # noqa: E731  texts side by side are one
        assert join(a) == join(b), html


def test_scratch_tables_go(spark, tmp_path):
    with common.scratch(spark):
        df = common.stored(spark.range(5))
        df.write.parquet(f"{tmp_path}/out")
        at = df.inputFiles()[0]
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        df.count()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5 and Counter(at)

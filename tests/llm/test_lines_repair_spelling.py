"""Line dedup, structure repair and spelling variants against brute force and on odd inputs."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from spectrion.llm import line_dedup, spelling, structure_repair
from spectrion.llm.registry import QUERIES

DIR = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_lines(docs, least_docs=2):
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = low(line.strip(BLANKS))
            if len(k) >= 10:
                holders[k].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(low(line.strip(BLANKS)), set())
            known = [x for x in held if x is not None]
            first = min(known) if known else None
            if len(held) < least_docs or d == first:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINES = [
    (3, "One shared line here\nown line of three\n\none SHARED line here  "),
    (1, "\t one shared line here\x0b\nshort\nshort"),
    (2, "short\nÉCOLE est une ligne\nOne shared line here"),
    (4, "école est une ligne\nÉcole est une ligne\nécole est une ligne"),
    (5, None),
    (6, ""),
    (7, "\n\n"),
    (8, "One shared line here"),
    (8, "only in eight twice\nx"),
    (8, "only in eight twice\nx"),
    (None, "One shared line here\nonly without a number"),
    (None, "only without a number\nshort"),
    (9, "exactly 10\nexactly 9"),
    (10, "EXACTLY 10\nexactly 9"),
]


@pytest.mark.parametrize("least", [2, 3])
def test_lines_by_brute_force(spark, least):
    docs = spark.createDataFrame(LINES, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, least_docs=least).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(LINES, least)


def test_lines_keep_other_columns_and_long_texts(spark):
    many = "\n".join(f"line number {i % 7000} of a long text" for i in range(20_000))
    docs = spark.createDataFrame([(2, many, "a", 5), (1, "line number 6999 of a long text", "b", 6)], "doc_id long, text string, row string, own long")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[2].row, got[2].own, got[2].n_lines, got[2].n_dropped) == ("a", 5, 20_000, 2)
    assert got[2].kept_text == "\n".join(x for x in many.split("\n") if x != "line number 6999 of a long text")
    assert got[1].n_dropped == 0
    clash = docs.select("doc_id", "text", F.lit("x").alias("n_lines"), F.lit(1).alias("gone"), F.lit(1).alias("kept_text"))
    assert line_dedup.dedup_lines(clash).where("doc_id = 2").select("n_lines", "gone").first() == (20_000, 1)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_without_heavy_keys_in_one_task(spark):
    docs = spark.createDataFrame([(i, f"a line of everybody\nthe line of number {i}\n{'common tail line' if i % 3 else 'odd'}") for i in range(400)], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)
    assert got == brute_lines([tuple(r) for r in docs.collect()])


def test_lines_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    expected = con.sql(line_dedup.OP11_SQL)
    got = QUERIES["op11_line_dedup"](spark, DIR).select(*expected.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected.fetchall(), key=repr)


# --- structure repair ---


def brute_repair(rows):
    """Best first search over (row, state) by (cost, audit): every edit at every place."""
    seen, marks = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        marks.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    ok = re.compile(r"(s?(ua)+)?$")
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in made)
        if any(not r for r, _ in made) or not re.match(r"s?(ua)*u?$", initials):
            continue
        if (i, initials[-1:], len(initials) > 0 and initials == "s") in done:
            continue
        done.add((i, initials[-1:], len(initials) > 0 and initials == "s"))
        if i == len(rows) and ok.match(initials):
            return cost, audit, list(made), Counter(marks)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, (*made, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made))
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*made, rows[i])))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, (*made, (role, rows[i][1]))))


def counted(rows):
    out = []
    for row in rows:
        if out and out[-1][1:3] == row:
            out[-1][3] += 1
        else:
            out.append([len(out), *row, 1])
    return [tuple(r) for r in out]


def test_repair_by_brute_force():
    pick = random.Random(5)
    texts = ["Fine.", "So?", "cut off", "", " \t", "Other!", "more cut", "Last one."]
    for _ in range(600):
        rows = [(pick.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), pick.choice(texts) + pick.choice(["", str(pick.random()) + "."])) for _ in range(pick.randrange(0, 9))]
        cost, audit, made, marks = brute_repair(rows)
        got = structure_repair.mend(counted(rows))
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert [(r["role"], r["text"]) for r in got["repaired"]] == made
        assert [got[k] for k in ("blank", "duplicate", "truncated")] == [marks[k] for k in ("blank", "duplicate", "truncated")]


def test_long_runs_take_powers():
    rows = [(i, "user", f"Number {i}.", 1) for i in range(5000)] + [(9000, "assistant", "Done.", 4000)]
    got = structure_repair.mend(rows)
    # 2,500 of the users become assistants (R at every other place) rather than go
    assert got["cost"] == 2 * 3999 + 2499 + 2
    assert got["audit"].endswith("D" * 3999) and len(got["audit"]) == 9000
    assert got["illegal"] == 4999 + 3999 and got["gaps"] == 9000 + 1 - 5001
    assert structure_repair.power("u", 3) == structure_repair.product(structure_repair.power("u", 2), structure_repair.power("u", 2))


def python_damage(rows):
    """(conv, [(turn, role, text)]) as the contract says."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    return out


def expected_repairs(rows):
    out = []
    for conv, given in python_damage(rows).items():
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        cost, audit, made, marks = brute_repair([r[1:] for r in given])
        turns = {r[0] for r in given if r[0] is not None}
        initials = [r[1][:1] for r in given]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks["blank"], marks["duplicate"], marks["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_repair_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = QUERIES["op12_structure_repair"](spark, DIR)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_repairs([tuple(r) for r in table.collect()])


def test_repair_of_odd_rows(spark, tmp_path):
    pick = random.Random(8)
    rows = [(pick.choice([1, 2, 3, None]), pick.choice([None, 0, 1, 2, 3, 9]), pick.choice(["user", "assistant", None, "system", ""]), pick.choice(["Yes.", "No", None, "", "é." * 40_000])) for _ in range(24)]
    gone = next(c for c in range(100, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Dropped.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1)).withColumn("copies", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, QUERIES["op12_structure_repair"](spark, str(tmp_path)).collect()), key=repr)
    assert got == expected_repairs(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure_repair.repair(structure_repair.damaged(empty)).count() == 0


# --- spelling variants ---


def brute_words(docs):
    total = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def edits(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def brute_variants(n):
    letters = set("".join(n))
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def test_spelling_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, DIR)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_variants(brute_words(docs))


@pytest.mark.parametrize("crowded", [2, 40, 4096])
def test_spelling_lists_of_any_size(spark, crowded):
    pick = random.Random(crowded)
    words = {"".join(pick.choice("abç") for _ in range(pick.choice([7, 7, 8, 9, 12]))): pick.choice([2, 3, 20, 35, 200, 4000]) for _ in range(900)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(map(tuple, spelling.variants(frame, crowded=crowded).collect()), key=repr)
    assert got == brute_variants(words)


def test_spelling_of_odd_texts(spark):
    long = "Wahrscheinlich " * 30_000
    rows = [(1, None), (2, ""), (None, "straße Straßen STRASSEN straßen naïvement Naïvement"), (3, long), (3, long), (4, "x" * 5000 + " " + "x" * 5000), (5, "x" * 4999 + "y " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    counted = {r.word: r.n for r in spelling.count_words(docs).collect()}
    assert counted == brute_words(rows)
    assert sorted(map(tuple, spelling.variants(spelling.count_words(docs)).collect()), key=repr) == brute_variants(counted)
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0

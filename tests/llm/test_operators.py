"""Each operator against a brute-force version or known answers, and on odd inputs."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrion.llm import byte_bpe, chat_format, decontamination, html_extract, pii, quality_rules, secrets_scan, simhash, suffix_dedup, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a house river stone walks slowly under bright evening light while birds sing over quiet fields near old mills".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[k], t, "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, a null id and ties."""
    long = prose(1, 40_000)
    texts = [None, "", " \n\t ", long, long, "x" * 200_000, prose(2, 60), prose(2, 60), "😀 é ß " * 50]
    return documents(spark, texts, [0, 1, 2, 3, 4, 5, 6, 6, None])


@pytest.fixture(scope="module")
def clashing(odd):
    """The same with columns whose names the operators use themselves."""
    return odd.withColumns({c: F.lit(7) for c in ("_m", "broken_rules", "fp", "doc", "spans", "maybe", "word", "_rank", "hash", "base", "found", "kept", "host", "pii")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


STAGES = [quality_rules.stage, simhash.stage, decontamination.stage, secrets_scan.stage]


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns(spark, stage, clashing, none, tmp_path):
    spark.createDataFrame([(0, prose(9, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert stage(spark, none, str(tmp_path)).count() == 0
    out = stage(spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns
    assert {tuple(r) for r in out.select("_m", "fp", "doc").collect()} <= {(7, 7, 7)}


def columns(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_clashing_columns_change_nothing(spark, odd, clashing):
    bench = spark.createDataFrame([(0, prose(2, 60))], "item_id long, text string")
    worse = bench.withColumns({c: F.lit(7) for c in ("doc_id", "hash", "w", "doc", "maybe")})
    for work in (byte_bpe.encode_table, secrets_scan.scan_table, suffix_dedup.remove, pii.scan):
        plain, full = work(odd), work(clashing)
        names = [c for c in plain.columns if c not in ("lang", "source", "n_chars")]
        assert columns(plain, *names) == columns(full, *names)
    plain = decontamination.leaks(odd, bench)
    assert columns(plain, *plain.columns) == columns(decontamination.leaks(clashing, worse), *plain.columns) != []
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, None, None), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    plain = chat_format.conversations(chat_format.chains(turns))
    more = chat_format.chains(turns).withColumns({c: F.lit(7) for c in ("leaf", "ancestor", "steps", "path", "rank", "mean")})
    assert columns(plain, *plain.columns) == columns(chat_format.conversations(more), *plain.columns)


def test_empty_tables(spark, none):
    assert pii.scan(none).count() == secrets_scan.scan_table(none).count() == byte_bpe.encode_table(none).count() == suffix_dedup.remove(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.conversations(chat_format.chains(turns)).count() == 0


# Quality rules


def brute_quality(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {p + k for at in grams.values() if len(at) > 1 for p in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, odd):
    texts = [prose(i, n) for i, n in enumerate([5, 19, 20, 300])] + ["a b c d e f g h " * 9, "one two\none two\n\n \nthree", "a # b *** | <c>\u2003d"]
    df = documents(spark, texts).unionByName(odd.where("length(text) < 5000 or text is null"))
    rows = quality_rules.judge(df).select("text", *quality_rules.flat("_m"), "broken_rules").collect()
    for r in rows:
        assert tuple(r[1:6]) == brute_quality(r["text"])
        assert ("few_words" in r["broken_rules"]) == (r["n_words"] < 20)


def test_quality_keeps_prose(spark):
    assert quality_rules.stage(spark, documents(spark, [prose(3, 200), "w " * 10]), "").count() == 1


# Secrets


def test_secret_layers():
    inner = 'password = "hunter2hunter2"'
    coded = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(zlib.compress(inner.encode())).decode()
    twice = base64.b64encode(packed.encode()).decode()
    for hidden in (coded, packed, twice, quote(inner, safe=""), quote(quote(inner, safe=""), safe=""), "".join(f"\\u{ord(c):04x}" for c in inner)):
        text = f"before {hidden} after"
        base, found, layers, unopened = secrets_scan.search(text)
        assert found and not unopened and layers
        a, b, kind = found[-1]
        assert kind == "assign" and 7 <= a < b <= 7 + len(hidden)
    exact = secrets_scan.search(f"x {quote('token=abcdefgh')} y")[1]
    assert [f"x {quote('token=abcdefgh')} y"[a:b] for a, b, _ in exact] == [quote("token=abcdefgh")]


def test_secret_base_rules():
    text = "Api_Key: 'abc' API-KEY=x secret=\"12345678\" AKIA123456789012 AKIA12345 " + "0f" * 16 + " " + "0f" * 15
    assert [k for _, _, k in secrets_scan.scan(text)] == ["assign", "access", "hex"]
    assert secrets_scan.scan("") == []


def test_secret_cycles_and_length():
    word = "A" * 300_000 + "%41" + "z" * 300_000 + " " + "\\u0041x" * 20_000
    assert secrets_scan.search(word)[1] == []


def test_secret_repeated_layers(spark):
    inner = b'password = "hunter2hunter2"'
    once = base64.b64encode(inner)
    for hidden in (base64.b64encode(once), base64.b64encode(gzip.compress(once, mtime=0)), quote(quote(once, safe=""), safe="").encode() if b"=" in once else base64.b64encode(base64.b64encode(once))):
        hidden = hidden.decode()
        text = f"one {hidden} two {hidden} three"
        spans = secrets_scan.search(text)[1]
        assert all(any(i <= a < b <= i + len(hidden) for a, b, _ in spans) for i in (4, text.rindex(hidden)))
        assert secrets_scan.merged(spans)[0][1] < text.rindex(hidden) <= secrets_scan.merged(spans)[1][0]
    row = secrets_scan.redact(documents(spark, [text])).first()
    assert row["text"].count("[SECRET]") == 2


def test_secret_borders_of_runs():
    def spans(text):
        return [text[a:b] for a, b in secrets_scan.merged(secrets_scan.search(text)[1])]

    inner = "password=hunter2hunter2"
    coded = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(zlib.compress(inner.encode())).decode()
    padded = base64.b64encode(b"token: abcdefgh12345").decode()
    for hidden in (coded, packed):
        bare = hidden.rstrip("=")
        for text in (f"data={hidden}", f"q=1&d={hidden}&e=2", f"https://h.org/x/{hidden}", f"https://h.org/xy/{hidden}?a=1", f"file_name-{hidden}"):
            (got,) = spans(text)
            assert got[1:-4] in bare and len(got) >= len(bare) - 1, text
    assert padded.endswith("=") and len(spans(padded + coded)) >= 1 and "".join(spans(padded + coded)).count("=") <= 2
    assert [k for _, _, k in secrets_scan.search(padded + coded)[1]] == ["assign", "assign"]
    for text in ("p%61ssword = hunter2hunter2", "\\u0070assword = hunter2hunter2", "p%61ssword: 'hunter2hunter2'", 'p%61ssword" : "hunter2hunter2'):
        assert [x.rstrip("'\"") for x in spans(f"so {text}")] == [text.rstrip("'\"")]
    long = base64.encodebytes((prose(4, 30) + " " + inner + " " + prose(5, 30)).encode()).decode()
    wrapped = base64.encodebytes(zlib.compress((prose(4, 90) + " " + inner).encode())).decode()
    for lines in (long, wrapped, long.replace("\n", "\r\n  ")):
        (got,) = spans(f"a key:\n{lines}\nend")
        assert got in lines


def test_secret_compressed_to_the_end():
    inner = 'password = "hunter2hunter2"'

    def kinds(raw):
        hidden = base64.b64encode(raw).decode()
        _, found, _, unopened = secrets_scan.search(f"x {hidden} y")
        assert all((a, b) == (2, 2 + len(hidden)) for a, b, _ in found)
        return [k for _, _, k in found], unopened

    blank = "é lorem ipsum " * 1_300_000
    assert len(blank.encode()) > 1 << 24 and len(("x" + blank).encode()[: 1 << 24].decode(errors="ignore")) > 0
    for text in (blank + inner, inner + "x" + blank, inner + blank):
        assert kinds(zlib.compress(text.encode(), 1)) == (["assign"], 0)
    # a secret where chunks meet
    assert kinds(gzip.compress((("a " * (1 << 21))[: -len(inner) // 2] + inner + " b" * (1 << 21)).encode(), 1)) == (["assign"], 0)
    two = gzip.compress(b"nothing here, ") + gzip.compress(inner.encode()) + zlib.compress(b" AKIA123456789012")
    assert kinds(two) == (["assign", "access"], 0)
    assert kinds(zlib.compress(b"q" * (1 << 25) + inner.encode(), 1))[1] == 1
    broken = bytearray(zlib.compress((inner + prose(1, 9000)).encode()))
    broken[-1] ^= 255
    assert kinds(bytes(broken)) == (["assign"], 1)


def test_secret_table(spark, odd):
    rows = secrets_scan.scan_table(odd).collect()
    assert len(rows) == odd.count() and all(r["base"] == [] for r in rows)
    out = secrets_scan.stage(spark, documents(spark, ["keep this", "a token=abcdefgh b", None]), "").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["keep this", "a [SECRET] b", None]
    assert out[1]["n_chars"] == len("a [SECRET] b")


# SimHash


def brute_fingerprint(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in ["", "One", "a b c", "A b c D", prose(5, 300), "É È a b c d"]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_components(codes):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(codes):
        for j in range(i):
            if bin(a ^ codes[j]).count("1") <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(codes))]


@pytest.mark.parametrize("part", [8192, 16])
def test_components_with_crowded_roots(spark, part, monkeypatch):
    r = random.Random(part)
    centres = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    codes = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(8)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(signed)], "doc_id long, fp long")
    monkeypatch.setattr(simhash.links, "__defaults__", (4, part))
    got = {x["doc_id"]: x["component_id"] for x in simhash.classes(df).collect()}
    assert [got[i] for i in range(len(codes))] == brute_components(codes)


@pytest.mark.parametrize("split", [5, 6, 8])
def test_masks_lose_no_link(split):
    r = random.Random(split)
    masks = simhash.masks(split)
    assert len(masks) == {5: 5, 6: 15, 8: 70}[split]
    for _ in range(500):
        differ = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not m & differ for m in masks)


def test_components_with_more_roots(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(20)]
    codes = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(6)})
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    few, many = ({(x["u"], x["root"]) for x in simhash.components(simhash.links(df, split=n)).collect()} for n in (5, 8))
    assert few == many and few


def test_simhash_stage_judges_texts_apart(spark):
    a, b = prose(1, 200), prose(2, 200)
    docs = documents(spark, [a, a, b, b, b], [1, 5, 5, 7, 5])
    assert sorted((r["doc_id"], r["text"] == a) for r in simhash.stage(spark, docs, "").collect()) == [(1, True), (5, False)]


def test_simhash_stage(spark, odd):
    out = simhash.stage(spark, odd, "").collect()
    ids = [r["doc_id"] for r in out]
    assert ids.count(None) == 1 and ids.count(6) == 1 and 4 not in ids and 3 in ids


# Byte-level BPE


def test_bpe_equals_ranks():
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    codec = byte_bpe.codec(path, pattern)
    ranks = {t: i for i, t in enumerate(byte_bpe.vocabulary(path))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ["", prose(6, 400), "  \n\t x  ", "日本語 😀 <|endoftext|> \x00\x1c\x85\xa0", "it's we'LL 3½ a_b", "z" * 3000, "▁ ▁▁a"]:
        ids = codec.encode(text)
        assert ids == enc.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_table(spark, odd, none):
    rows = byte_bpe.encode_table(odd)
    back = byte_bpe.decode_table(rows)
    for r, raw in zip(rows.collect(), odd.collect()):
        data = (raw["text"] or "").encode()
        assert r["decoded_sha256"] == hashlib.sha256(data).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert [bytes(b["bytes"]) for b in back.collect()] == [(raw["text"] or "").encode() for raw in odd.collect()]
    assert byte_bpe.encode_table(none).count() == 0


# Decontamination


def test_reparameterised_question(spark):
    item = "A train leaves the busy station at 14 km per hour and Anna walks 3 miles to meet it before the evening light fades over the hills"
    changed = item.replace("14", "250").replace("Anna", "Boris").replace("3 miles", "7 miles")
    inconsistent = "Anna sees 3 birds. " * 3
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "so they say Anna met Anna and then Anna left Anna alone for good reasons there")], "item_id long, text string")
    texts = [f"intro words here. {item}.", f"other start {changed} and more", prose(7, 300), None, inconsistent, "so they say Anna met Boris and then Carl left Dora alone for good reasons there", "### " + item.upper()]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(documents(spark, texts), bench).collect()}
    assert {(0, 0), (1, 0)} <= found and not {d for d, _ in found} & {2, 3, 4, 5}


def test_occurrences_are_judged_apart(spark):
    item = "A train leaves the busy station at 14 km per hour and Anna walks 3 miles to meet it before the evening light fades over the hills"
    variants = [item.replace("14", str(n)).replace("Anna", who).replace("3 miles", f"{n + 1} miles") for n, who in ((250, "Boris"), (90, "Carl"))]
    words = item.split()
    # windows of eight words in any order, each a fragment on its own
    scattered = " ".join(" ".join(words[i : i + 8]) + f" {prose(i, 40)}" for i in (16, 12, 17, 13, 18, 14, 15, 11))
    inserted = " ".join([*words[:12], "quite", "slowly", *words[12:]])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = [f"{item}. {variants[0]}.", f"{prose(1, 40)} {variants[0]}. {prose(2, 90)} {variants[1]}.", scattered, inserted]
    rows = decontamination.leaks(documents(spark, [*texts, item, variants[0]], [0, 1, 2, 3, None, None]), bench).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == [0, 1, 3, None]
    assert all(r["consistency"] == 1 and r["coverage"] <= 1 for r in rows)


def test_verbatim_copies_always_match(spark):
    items = ["What is 12 times 7?", "Anna, Boris, Carl and Dora pay 12 kg, 13 kg, 14 kg and 15 kg to Emil, Fritz, Gustav and Hans in Berlin, Hamburg and Ulm", "In Paris Marie Curie met Albert Einstein and Max Planck while Niels Bohr and Lise Meitner went to Vienna by train"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{prose(i, 40)}. {t} {prose(9 - i, 40)}" for i, t in enumerate([*items, items[1].lower(), items[2].upper(), "What is 13 times 7?"])]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(documents(spark, [*texts, items[0]]), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 1), (4, 2), (5, 0), (6, 0)}


def test_decontamination_stage(spark, odd, none, tmp_path):
    bench = spark.createDataFrame([(0, prose(2, 60))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["doc_id"] for r in decontamination.stage(spark, odd, str(tmp_path)).collect()} == {None, 0, 1, 2, 3, 4, 5}
    assert decontamination.stage(spark, none, str(tmp_path)).count() == 0
    twice = documents(spark, [prose(2, 60), prose(5, 60), prose(2, 60) + " end", prose(6, 60), None], [1, 1, None, None, None])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontamination.stage(spark, twice, str(tmp_path)).collect()) == sorted([(1, prose(5, 60)), (0, prose(6, 60)), (0, "")])
    assert decontamination.leaks(odd, bench.limit(0)).count() == 0


# Repeated bytes


def brute_repeats(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    covered = [np.zeros(len(t), bool) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                covered[d][i : i + length] = True
    return [(int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~c])).hexdigest()) for t, c in zip(texts, covered)]


def test_aligned_repeats():
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(10, 40))).encode() for _ in range(60)]
    places, group = np.array([r.randint(0, 5) for _ in texts]), np.array([r.randint(0, 4) for _ in texts])
    got = set(zip(*map(np.ndarray.tolist, suffix_dedup.aligned_repeats(texts, group, 6, places))))
    expected = {
        (i, s) for i, t in enumerate(texts) for s in range(len(t) - 5) for j, u in enumerate(texts)
        if i != j and group[i] == group[j] and (k := s - places[i] + places[j]) >= 0 and u[k : k + 6] == t[s : s + 6]
    }
    assert got == expected and got


@pytest.mark.parametrize(("seed", "crowd"), [(0, 4096), (1, 4096), (2, 0), (3, 3)])
def test_repeated_bytes(spark, seed, crowd):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcde é") for _ in range(r.randint(380, 1500))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = ["".join(r.choice("abcdefgh") for _ in range(r.randint(0, 600)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, max(0, len(p) - 400))
            parts += [p[a : a + r.randint(300, 1500)], "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 300)))]
        texts.append("".join(parts))
    texts += ["", "ab" * 700, "c" * 1000, texts[0], texts[0]]
    rows = suffix_dedup.remove(documents(spark, texts), crowd=crowd).orderBy("doc_id").collect()
    expected = brute_repeats([t.encode() for t in texts], 400)
    assert [(x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows] == expected
    assert all(x["n_bytes"] == len(t.encode()) and len(x["kept"]) == x["n_bytes"] - x["n_removed"] for x, t in zip(rows, texts))


def brute_passages(texts, size=50):
    seen = {}
    for d, t in enumerate(texts):
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            seen.setdefault(b" ".join(w[i : i + size]), set()).add(d)
    return {d for docs in seen.values() if len(docs) > 1 for d in docs}


def test_shared_passages(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 75, 140)]
    texts = [f"{text(r.randint(0, 90))} {p}\n{text(r.randint(0, 90))}" for p in passages for _ in range(2)]
    twice = text(70)
    texts += [f"{twice} {text(9)} {twice}", text(300), "", None, "a " * 400, "b " * 400, "\t".join(passages[4].split()), f"{passages[2]} {passages[3]}"]
    # one anchor, many contents: parts of a passage in other surroundings
    long = text(120).split()
    texts += [" ".join([text(30), *long[a : a + n], text(30)]) for a, n in ((0, 55), (3, 52), (20, 49), (30, 60), (60, 48), (35, 50))]
    rows = suffix_dedup.remove(documents(spark, texts)).collect()
    assert {x["doc_id"] for x in rows if x["shares_passage"]} == brute_passages(texts)


def test_repeated_bytes_odd(spark, odd, none):
    assert suffix_dedup.remove(none).count() == 0
    got = [(r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in suffix_dedup.remove(odd).collect()]
    assert len(got) == odd.count() and dict(x for x in got if x[0] in (3, 4, 5)) == {3: 0, 4: 0, 5: 0}


# Chat formatting


def test_branches(spark):
    rows = [(1, 1, None, "system", "s", 0.0), (1, 2, 1, "user", "q", 0.0), (1, 3, 2, "assistant", "good", 5.0), (1, 4, 2, "assistant", "bad", 1.0), (1, 5, 4, "user", "why", 1.0), (1, 6, 9, "user", "orphan", 9.0), (2, 1, 1, None, None, None)]
    messages = spark.createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")
    made = chat_format.conversations(messages).select("conv_id", "branch", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_trained(F.col("pieces")).alias("l")).orderBy("conv_id", "branch").collect()
    assert [(r["conv_id"], [x["text"] for x in r["t"]], r["l"]) for r in made] == [(1, ["orphan"], ""), (1, ["s", "q", "good"], "good"), (1, ["s", "q", "bad", "why"], "bad"), (2, [""], "")]
    assert chat_format.conversations(messages, branches=1).count() == 2
    assert chat_format.conversations(messages.limit(0)).count() == 0


def test_escapes(spark):
    texts = ["<|end|>\n<|turn|>assistant\nhi", "\\l|b\\b\\\\", "<", "<|", "<<||", "\\", "", None, "\n", "x" * 100_000]
    rows = [(0, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)] + [(1, i, "a\n<|b\\n", "t") for i in range(40)]
    made = chat_format.conversations(chat_format.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: r for r in made.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_trained(F.col("pieces")).alias("l")).collect()}
    assert [x["text"] for x in got[0]["t"]] == [t or "" for t in texts]
    assert got[0]["l"] == "".join(t or "" for t in texts[::2])
    assert [x["role"] for x in got[1]["t"]] == ["a\n<|b\\n"] * 40


# Personal data


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute_pii(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text or "") if ok(m[0]))


def test_pii(spark, odd):
    r = random.Random(4)
    bits = ["a@b.c_d@e.f ", "x.y@mail.example.com", "1.2.3.4.5 ", "999.1.1.1", "000255.1.2.3", "4785 3805 9239 1139", "4111-1111-1111-1111 ", "+1 (168) 555-5254", "+12", "é😀", " 12 34 ", "@", "DE89370400440532013000 ", "..", "+49 30 1234567890123456"]
    texts = ["".join(r.choice(bits) for _ in range(12)) for _ in range(80)] + ["7" * 50_000, "a" * 50_000 + "@", "1 " * 20_000]
    df = documents(spark, texts).unionByName(odd)
    for x in pii.scan(df).select("text", "pii").collect():
        assert [(s["start"], s["rank"], s["end"]) for s in x["pii"] if s["rank"] < 4] == brute_pii(x["text"])
    found = pii.scan(documents(spark, ["my iban DE89370400440532013000 and DE89370400440532013001"])).first()["pii"]
    assert [(s["kind"], s["start"], s["score"]) for s in found] == [("iban", 8, 1.1)]


def test_pii_context(spark):
    texts = ["shipping 1.2.3.4 now", "host 1.2.3.4", "1.2.3.4 is the server", "version 1.2.3.4", "account DE89 3704 0044 0532 0130 00", "konto: DE89 3704 0044 0532 0130 01"]
    rows = pii.scan(documents(spark, texts)).orderBy("doc_id").collect()
    assert [[(s["kind"], s["start"], s["score"]) for s in r["pii"]] for r in rows] == [[("ip", 9, 0.6)], [("ip", 5, 0.8)], [("ip", 0, 0.8)], [("ip", 8, 0.4)], [("iban", 8, 1.1)], []]


def test_pii_in_long_texts(spark):
    n = 40_000
    row = pii.scan(documents(spark, [" ".join(f"é{i}.x@mail.org" for i in range(n))])).select(F.size("pii").alias("n"), F.col("pii")[n - 1]["end"].alias("end"), F.length("text").alias("size")).first()
    assert (row["n"], row["end"]) == (n, row["size"])


# URL filters


def test_url_filters(spark):
    entries = [("example.com", "2022-01-10", "block"), ("example.com", "2022-04-01", "remove"), ("good.example.com", "2022-02-01", "allow"), ("example.com", "2022-04-01", "block"), (None, "2022-01-01", "block"), ("late.org", "2023-01-01", "block"), ("late.org", None, "block"), ("example.com", "2022-09-09", "remove")]
    df = spark.createDataFrame(entries, "domain string, d string, action string").select("domain", F.to_timestamp("d").alias("listed_at"), "action")
    asked = [("http://a.example.com/x", "2022-01-09"), ("http://a.example.com/x", "2022-01-10"), ("https://user@Good.Example.com:80/", "2022-03-01"), ("http://example.com", "2022-08-31"), ("http://example.com", "2022-09-10"), ("nonsense", "2022-01-01"), (None, "2022-01-01"), ("http://late.org", None), ("http://late.org", "2024-06-06"), ("http://late.org", "2024-06-06")]
    captures = spark.createDataFrame(asked, "url string, d string").select("url", F.to_timestamp("d").alias("fetched_at"), "d", F.lit(1).alias("blocked"))
    got = [(r["url"], r["d"], r["blocked"]) for r in url_filters.judge(captures, df).collect()]
    expected = [False, True, False, True, False, None, None, None, True, True]
    assert sorted(got, key=str) == sorted([(u, d, e) for (u, d), e in zip(asked, expected)], key=str)
    assert url_filters.judge(captures, df.limit(0)).where("blocked").count() == 0
    assert url_filters.judge(captures.limit(0), df).count() == 0


def test_hosts_and_their_domains(spark):
    asked = {
        "http://[2001:DB8::1]:80/x": ("[2001:db8::1]", ["[2001:db8::1]"]), "http://10.0.0.1/": ("10.0.0.1", ["10.0.0.1"]), "https://a.shop.co.uk.": ("a.shop.co.uk", ["a.shop.co.uk", "shop.co.uk"]),
        "http://co.uk/": ("co.uk", ["co.uk"]), "ftp://u:p@x@h.a.org?q=@z": ("h.a.org", ["h.a.org", "a.org"]), "http://localhost:1": ("localhost", ["localhost"]), "http:///x": (None, None), "http://[bad/": (None, None), "": (None, None),
    }
    host = url_filters.host_of(F.col("url"))
    got = spark.createDataFrame([(u,) for u in asked], "url string").select("url", host.alias("host"), url_filters.domains_of(host).alias("domains")).collect()
    assert {r["url"]: (r["host"], r["domains"]) for r in got} == asked


def test_dated_entries_against_brute_force(spark):
    r = random.Random(3)
    day = lambda: f"{r.choice([2019, 2020, 2021])}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:00:00"
    names = ["a.org", "x.a.org", "b.net", "y.x.a.org"]
    entries = sorted({(r.choice(names[:3]), day(), r.choice(url_filters.ACTIONS)) for _ in range(60)})
    asked = [("http://" + r.choice(names) + "/", day()) for _ in range(300)] + [("http://a.org/", "9999-12-31 00:00:00"), ("http://a.org/", "0001-01-01 00:00:00"), ("http://a.org/", entries[0][1])]

    def verdict(host, at):
        for name in (host.split(".", k)[k] for k in range(host.count("."))):
            known = [(t, url_filters.ACTIONS.index(a), a) for d, t, a in entries if d == name and t <= at]
            if known and max(known)[2] != "remove":
                return name, max(known)[2], max(known)[0]
        return None, None, None

    captures = spark.createDataFrame(asked, "url string, d string").select("url", "d", F.to_timestamp("d").alias("fetched_at"))
    listed = spark.createDataFrame(entries, "domain string, d string, action string").select("domain", F.to_timestamp("d").alias("listed_at"), "action")
    out = url_filters.judge(captures, listed).select("url", "d", "matched_domain", "action", F.date_format("listed_at", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()
    assert sorted(map(tuple, out), key=str) == sorted(((u, d, *verdict(u[7:-1], d)) for u, d in asked), key=str)


# HTML


def test_html_rules():
    page = html_extract.Page(
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><div class='ad box'>buy</div><article><h1>A &amp; B</h1><p>one\n two<p>three<br>four"
        "<script>var x='</p>';</script><div class=\"comments\"><p>reader</div><form>f</form><!-- c --><p>caf&eacute; <b>bold</b> &am</article><footer>&copy;</footer>"
    )
    assert page.text() == "A & B\none two\nthree\nfour\ncafé bold &am"
    assert html_extract.Page(None).text() == "" and html_extract.Page("just text").text() == "just text"
    assert html_extract.Page("<p" + " a" * 50_000).text() == html_extract.Page("<p" + " a" * 50_000).text()
    assert html_extract.Page("<b>" * 5000 + "deep").text() == "deep"


@pytest.mark.parametrize("around", ['<div class="article-search-results">', '<div class="social-history">', '<div id="alert-story">', '<section class="form-and-function">', '<div class="modal">', '<div class="ad"><article>'])
def test_html_names_around_main_text(around):
    assert html_extract.Page(f"<body><nav>n</nav>{around}<p>body text</p></div></body>").text() == "body text"


def test_html_structure():
    text = lambda html: html_extract.Page(html).text()
    assert text("<main><p>a</p></main><article>teaser</article>") == "a"
    assert text("<main><div>before</div><article><ul><li>x<li>y</ul></article></main>") == "x\ny"
    assert text('<article>a<article class="comment">c</article><div class="comments-list">d</div><div class="listing">e</div></article>') == "a\ne"
    for raw in ("noscript", "template", "textarea", "title", "iframe"):
        assert text(f"<div><{raw}>one</div><p>two") == "one\ntwo"
    assert text("<div><script>var x = 1;</div><p>two") == "two"
    assert text('<div class="cookie-notice">c</div><div class="site-header">h</div><p>t') == "t"


def test_html_articles_keep_lists(spark):
    page = "<body><article><h1>story {0}</h1><ul><li>one</li></ul><p>again</p></article></body>"
    df = spark.createDataFrame([(i, "http://h.org/", page.format(i)) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(df).collect()} == {f"story {i}\none\nagain" for i in range(9)}


def brute_templates(pages, least=5, share=0.1):
    """Paragraphs, one element each, of pages given as (host, paragraphs): those on many different pages of the host go."""
    seen, every = {}, {}
    for host, parts in pages:
        every.setdefault(host, set()).add("\n".join(parts))
        for p in parts:
            seen.setdefault((host, p), set()).add("\n".join(parts))
    gone = {k for k, v in seen.items() if len(v) >= max(least, share * len(every[k[0]]))}
    return ["\n".join(p for p in parts if (host, p) not in gone) for host, parts in pages]


def test_html_templates_by_share(spark):
    r = random.Random(2)
    tags = ("p", "h2", "div", "blockquote", "section")
    common = [prose(i, 6) for i in range(30)]
    pages = [(f"h{min(i % 4, 2)}.org", [r.choice(common) if r.random() < 0.5 else prose(1000 + 10 * i + k, 9) for k in range(r.randint(1, 6))]) for i in range(160)]
    html = ["<body>" + "".join(f"<{t}>{p}</{t}>" for p in parts for t in [tags[len(p) % 5]]) + "</body>" for _, parts in pages]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, ((h, _), x) in enumerate(zip(pages, html))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert [got[i] for i in range(len(pages))] == brute_templates(pages) and brute_templates(pages) != ["\n".join(p) for _, p in pages]


def test_html_templates(spark):
    box = "<div><p>Subscribe now</p></div>"
    pages = [(i, f"http://h.org/{i}", f"<body>{box}<div><p>story number {i} {prose(i, 30)}</p></div></body>") for i in range(8)]
    copies = [(100 + i, f"http://c.org/{i}", f"<body><div><p>{prose(9, 30)}</p></div></body>") for i in range(8)]
    few = [(200 + i, "http://f.org/", f"<body>{box}<p>lonely {i}</p></body>") for i in range(2)]
    odd = [(300, None, None), (301, "x", ""), (301, "x", "")]
    df = spark.createDataFrame(pages + copies + few + odd, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("doc", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert all(got[i] == re.sub(r"\s+", " ", f"story number {i} {prose(i, 30)}") for i in range(8))
    assert got[100] == prose(9, 30) and got[200] == "Subscribe now\nlonely 0" and got[300] == got[301] == ""
    assert html_extract.extract(df).count() == df.count() and html_extract.extract(df.limit(0)).count() == 0

"""Text operators against brute force, with nulls, blanks, repeats, ties, long texts, empty tables and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import decontaminate, licenses, main_text, ngram_join, packing, pii, quality, warc
from quayside.llm.chat import preferences
from quayside.llm.exact_dedup import distinct_texts, duplicate_report
from quayside.llm.query_pii import joined
from quayside.llm.shared import components
from quayside.llm.words import word_hashes

DOCS = "doc_id long, text string, kept string, _sha string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b c"), (2, "abc "), (3, "ab\tc  "), (4, None), (5, ""), (6, "x y"), (6, "x y"), (None, "lone"), (7, "word " * 50_000)]
    return spark.createDataFrame([(i, t, "k", "s") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_duplicates(docs, empty):
    got = duplicate_report(docs).collect()
    assert len(got) == 9 and duplicate_report(empty).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id not in (6,)}
    assert {by[i].keep_id for i in (1, 2, 3)} == {3} and by[3].kept and by[1].group_size == 3
    assert by[4].keep_id == by[5].keep_id == 4 and by[None].kept
    assert sorted(r.kept for r in got if r.doc_id == 6) == [False, True]
    kept = distinct_texts(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 6, 7]


def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and den * shared >= num * len(a | sets[j]):
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    low = defaultdict(lambda: 10**18)
    for (d, _), c in zip(rows, comp):
        low[c] = min(low[c], d)
    return sorted((d, len(s), low[c]) for (d, _), s, c in zip(rows, sets, comp))


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_components(spark, width, num):
    rnd = random.Random(width)
    rows = []
    for i in range(60):
        base = [rnd.choice("abcdefghijklmnopqrst") + str(rnd.randint(0, 99)) for _ in range(rnd.choice((2, 6, 12, 40, 120)))]
        for _ in range(4):
            own = list(base)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = "edit"
            rows.append((len(rows), " ".join(own).upper() if rnd.random() < 0.2 else "\n".join(own)))
    rows += [(1000, None), (1001, " \t"), (1002, "same"), (1003, "same")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, 100)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, width, num, 100)
    left = ngram_join.one_of_each_component(spark.createDataFrame(rows, "doc_id long, text string"), width, num, 100)
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute_components(rows, width, num, 100)})


def test_components_of_long_paths(spark):
    rnd = random.Random(4)
    path = rnd.sample(range(10_000), 300)
    edges = list(zip(path, path[1:])) + [(20_000 + i, 20_001 + i) for i in range(300)] + [(30_000, 30_000)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(path, min(path)), **dict.fromkeys(range(20_000, 20_301), 20_000)}


def test_ngram_words_of_two_alternating_letters_differ(spark):
    """Thue-Morse words of 1024 letters and their complements: equal under sums of powers modulo 2**64, so they were linked."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"x y {word}"), (4, f"x y {other}"), (5, f"{word} {other} {word} {word} {word}")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 3, 5)]


def test_ngram_empty(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_word_hashes_agree_with_words():
    long = "été " * 200_000 + "end"
    texts = ["A b\x0bC", None, "", long, "Straße_1 x-y"]
    for kind, split in (("space", lambda t: t.encode().lower().split()), ("letters", lambda t: re.findall(r"\w+", t.lower()))):
        seen = {}
        for t, h in zip(texts, word_hashes(texts, kind)):
            words = split(t or "")
            assert len(words) == len(h)
            for w, x in zip(words, h.tolist()):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def brute_matches(text, items):
    words, out = re.findall(r"\w+", (text or "").lower()), []
    for key, item in items:
        own = re.findall(r"\w+", (item or "").lower())
        if not own or not words:
            continue
        size, w = min(len(own), len(words)), min(5, len(own))
        grams = lambda x, w=w: Counter(tuple(x[i : i + w]) for i in range(len(x) - w + 1))
        best = max((decontaminate.weighted_similarity(grams(own), grams(words[s : s + size])) for s in range(len(words) - size + 1)), default=0)
        if best >= 0.8:
            out.append(key)
    return sorted(out)


def test_decontamination(spark):
    rnd = random.Random(5)
    word = lambda: "w" + str(rnd.randint(0, 300))
    items = [(i, " ".join(word() for _ in range(rnd.choice((3, 8, 30, 60))))) for i in range(40)] + [(40, None), (41, "")]
    rows = [(100, None), (101, "")]
    for i in range(80):
        passage = items[rnd.randrange(40)][1].split()
        for _ in range(rnd.randint(0, 2)):
            passage[rnd.randrange(len(passage))] = "changed"
        rows.append((i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]).upper()))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: sorted(m.item for m in r.matches) for r in decontaminate.benchmark_matches(df, bench).collect()}
    want = {d: brute_matches(t, items) for d, t in rows}
    assert got == want and any(want.values())
    assert {r.doc_id for r in decontaminate.clean_documents(df, bench).collect()} == {d for d, m in want.items() if not m}
    assert decontaminate.benchmark_matches(df, bench.limit(0)).where("size(matches) > 0").isEmpty()


def test_decontamination_in_portions(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(9)] + [(3, " ".join(f"w3x{j}" for j in range(8)))] * 40 + [(None, "lone item of this benchmark")]
    rows = [(1, f"a {items[0][1]} b {items[5][1]}"), (2, items[3][1]), (2, items[3][1]), (3, "nothing here"), (4, None), (None, f"{items[8][1]} {items[1][1]} lone item of this benchmark")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    reports = []
    for chars in (16 << 20, 100, 1):
        several, portions = decontaminate._portions(bench, "item_id", "text", chars)
        sizes = [sum(len(t) for _, t, _ in p) for p in portions]
        assert several == (len(sizes) > 1) == (chars <= 100) and max(sizes) <= max(chars, 50)
        got = decontaminate.benchmark_matches(df, bench, portion_chars=chars).collect()
        reports.append(sorted(((r.doc_id or 0), [(m.item, m.first_word, m.words, m.similarity) for m in r.matches]) for r in got))
        assert {r.doc_id for r in decontaminate.clean_documents(df, bench, portion_chars=chars).collect()} == {3, 4}
    assert reports[0] == reports[1] == reports[2] and [(d, [m[0] for m in ms]) for d, ms in reports[0]] == [(0, [None, 1, 8]), (1, [0, 5]), (2, [3] * 41), (2, [3] * 41), (3, []), (4, [])]


def test_hamming_index_finds_all():
    rnd = np.random.default_rng(1)
    stored, queries = rnd.integers(0, 2**63, 300, dtype=np.uint64), rnd.integers(0, 2**63, 200, dtype=np.uint64)
    who, which = decontaminate.HammingIndex(stored, 24).near(queries)
    want = {(i, j) for i, q in enumerate(queries.tolist()) for j, s in enumerate(stored.tolist()) if (q ^ s).bit_count() <= 24}
    assert set(zip(who.tolist(), which.tolist())) == want


def test_quality_held_out(spark, base):
    docs, labels = (spark.read.parquet(f"{base.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.scored(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.fold(F.col("doc_id")) == 1).toPandas()
    assert ((out.score >= 0.5) == (out.quality == 1)).mean() > 0.95


def test_quality_without_labels(docs, empty):
    forest = quality.train(docs, docs.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert {r.score for r in quality.scored(docs, forest).collect()} == {0.5}
    assert quality.good_documents(docs, forest).count() == docs.count() and quality.scored(empty, forest).count() == 0


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3}])
def test_packing_round_trip(spark, targets):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    words = ["the", "Thing.", "naïve", "don't", "x1y2", "***", "été,", "日本", "a b", "<|endoftext|>", "…", "ΣΑΣ"]
    rows = [(i, None if i == 5 else " \n".join(rnd.choice(words) for _ in range(rnd.randint(0, 300))), rnd.choice(["a", "a", "b", None])) for i in range(120)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "word_bpe_49k.json", length=256, window_sequences=4, targets=targets).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    place = defaultdict(list)
    for d, t, _ in rows:
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in own) == ids and all(r.doc_tokens * 4 == len(ids) for r in own)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
    assert sorted(place) == list(range(len(place)))
    for own in place.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        size = sum(n for _, n in own)
        assert size <= 256 and size & (size - 1) == 0
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string, source string"), "word_bpe_49k.json").count() == 0


def window_shares(spark, targets):
    """Tokens of each source in each window, of two large sources and sixty that hold a few tokens each."""
    rows = [(i, "thing " * 99, "a" if i % 2 else "b") for i in range(200)] + [(1000 + i, "small " * 29, f"s{i}") for i in range(60)]
    source = {i: s for i, _, s in rows}
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), "word_bpe_49k.json", length=256, window_sequences=4, targets=targets).collect()
    windows = defaultdict(Counter)
    for r in got:
        windows[r.sequence_id // 4][source[r.doc_id]] += r.length
    return windows


def test_every_window_holds_the_shares_of_the_sources(spark):
    windows = window_shares(spark, None)
    whole = [w for w in sorted(windows) if sum(windows[w].values()) == 1024]
    total = sum(map(sum, (c.values() for c in windows.values())))
    held = Counter()
    for w in whole:  # deficits carry over: after any number of windows each large source has its share
        held.update(windows[w])
        for s in "ab":
            assert abs(held[s] - (w + 1) * 1024 * 10_000 / total) < 2
    assert len(whole) >= 20


def test_targets_hold_even_for_the_smallest_source(spark):
    windows = window_shares(spark, {"a": 0.5, "b": 0.3, "s7": 0.2})
    assert windows[0]["s7"] == 30  # 0.2 of a window is more than it has: all of it comes first
    # 150 tokens until it is dry, from then on a and b share as 5 to 3 until a is dry as well
    for w in range(14):
        so_far = Counter()
        for v in range(w + 1):
            so_far.update(windows[v])
        rest = (w + 1) * 1024 - 150
        assert abs(so_far["a"] - 75 - rest * 5 / 8) < 2 and abs(so_far["b"] - 45 - rest * 3 / 8) < 2
    small = [f"s{i}" for i in range(60) if i != 7]
    assert not any(windows[w][s] for w in range(10) for s in small) and sum(windows[w][s] for w in windows for s in small) == 59 * 30


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def passes(kind, value):
        d = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    found = sorted((m.start(), i, m.end(), k) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if passes(k, m[0]))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def test_base_mentions(spark):
    rnd = random.Random(2)
    parts = ["255", "0", "1", "300", ".", ".", "a.b", "@", "c-d", ".com", " ", "+1", "(555) ", "4111 1111 1111 1111", "é😀", "-"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "a@b" + ".c" * 20_000), (2003, "1 " * 50_000)]
    got = {r.id: r.s for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).select("id", joined(F.filter("spans", lambda s: s["kind"] != "term")).alias("s")).collect()}
    assert got == {d: brute_base(t) for d, t in rows}


def test_disclosing_terms(spark):
    rows = [(i, f"common words {i} Zanzibar ann@x.org common words") for i in range(6)] + [(10 + i, "common words here") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.id: r for r in pii.spans(df).withColumn("s", joined(F.col("spans"))).collect()}
    assert out[0].s == "term:15:23,email:24:33" and out[12].s == ""
    clean = df.join(pii.spans(df).withColumnRenamed("id", "doc_id"), "doc_id").where("doc_id = 0").select(pii.sanitised(F.col("text"), F.col("spans"))).first()[0]
    assert clean == "common words 0  [EMAIL] common words"


def test_terms_of_values_that_occur_once(spark):
    rows = [(0, "common words Zanzibar ann@x.org common words")] + [(1 + i, f"common Quayside common u{i}@port.example common words") for i in range(12)] + [(20 + i, "common words here") for i in range(400)]
    rows += [(500 + i, "common Quayside common") for i in range(4)]
    out = {r.id: r.s for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).select("id", joined(F.col("spans")).alias("s")).collect()}
    assert out[0] == "term:13:21,email:22:31"
    # 12 of the 16 documents with the word have it next to an address of the domain: too few for any one address, enough for the domain
    assert all(out[1 + i].startswith("term:7:15,email:23:") for i in range(12)) and out[20] == out[500] == ""


def brute_terms(rows, reach=4, alpha=0.8):
    """Spans of the disclosing terms of every row, by counting pairs of entity and term one by one."""
    at, near, docs, mention_docs = {}, defaultdict(set), defaultdict(set), defaultdict(set)
    for d, t in rows:
        base = [x.split(":") for x in brute_base(t).split(",") if x]
        base = [(k, int(a), int(b)) for k, a, b in base]
        words = [m for m in re.finditer(r"[^\W\d_]+", t)]
        at[d] = [m for m in words if not any(a < m.end() and m.start() < b for _, a, b in base)]
        for m in words:
            docs[m[0].lower()].add(d)
        for k, a, b in base:
            v = t[a:b]
            digits = re.sub(r"\D", "", v)
            shared = {"email": v.split("@")[-1].lower(), "ip": v.rsplit(".", 1)[0], "card": digits[:6], "phone": digits[:-4]}[k]
            for c in (k + ":" + v, k + "~" + shared):
                mention_docs[c].add(d)
                for m in [m for m in at[d] if m.end() <= a][-reach:] + [m for m in at[d] if m.start() >= b][:reach]:
                    near[c, m[0].lower()].add(d)
    n = len(rows)
    telling = defaultdict(set)
    for (c, w), ds in near.items():
        df_c = len(mention_docs[c])
        if np.log(n * len(ds) / (df_c * len(docs[w]))) >= alpha * np.log(n / df_c):
            telling[w] |= mention_docs[c]
    return {d: [(m.start(), m.end()) for m in at[d] if d in telling[m[0].lower()]] for d, _ in rows}


def test_terms_in_whole_contexts(spark):
    rnd = random.Random(8)
    common = ["alpha", "Beta", "gamma", "12", "1980", "x", "été"]
    rows = [
        (900, "alpha Zanzibar 1980 card 4111 1111 1111 1111"),
        (901, "gamma Kilwa beta ann@x.org alpha " * 2 + "beta " * 60 + "Kilwa gamma"),
        (902, "Lamu list: " + ", ".join(f"u{i}@y.org" for i in range(40)) + " Mombasa"),
        (903, "alpha " + "Wort" * 90 + "ende bob@z.org 10.0.0.1 beta"),
        (904, "Pemba" + " " * 400 + "+1 (555) 010-9999 éann@q.org. 300.1.1.1 alpha"),
    ]
    for i in range(400):
        own = [rnd.choice(common) for _ in range(rnd.randint(0, 25))]
        if i % 8 == 0:
            own.insert(rnd.randint(0, len(own)), rnd.choice(["Ann", "Bob"]) + " " + rnd.choice(["ann@x.org", "bob@x.org", "4111 1111 1111 1111", "10.0.0.9", f"+1 555 01{i:03d} 22"]))
        rows.append((i, " ".join(own)))
    got = {r.id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_terms(rows)
    assert got == want
    words = {d: [t[a:b] for a, b in want[d]] for d, t in rows}
    assert "Zanzibar" in words[900] and words[901].count("Kilwa") == 3 and {"Lamu", "Mombasa"} <= set(words[902]) and "Wort" * 90 + "ende" in words[903] and "Pemba" in words[904]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é"), (2, "http://b/", "<p>é"), (3, None, None), (4, "u v", ""), (None, "x", "alone"), (5, "big", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.record_id: r for r in warc.read_archives(warc.write_archives(pages, f"{tmp_path}/w")).collect()}
    assert len(got) == 6 and all(r.verified for r in got.values())
    one = got["<urn:page:1>"]
    assert (one.record_type, one.refers_to, one.payload_bytes, one.payload) == ("revisit", "<urn:page:2>", 5, None)
    assert bytes(got["<urn:page:2>"].payload) == "<p>é".encode() and got["<urn:page:4>"].target_uri == "u%20v"
    assert got["<urn:page:3>"].refers_to == "<urn:page:4>" and got["<urn:page:none>"].record_type == "response"
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, f"{tmp_path}/v", least_bytes=6)).collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"{tmp_path}/e")).count() == 0
    data = warc.record("response", "<urn:page:1>", "u", b"abc")
    import io

    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(data[:-9])))
    raw = zlib.decompress(data, 31)
    assert warc.parse(raw)["verified"] and not warc.parse(raw.replace(b"abc", b"abd"))["verified"]


def test_main_text_of_marked_pages(spark, base):
    import html

    pages = spark.read.parquet(f"{base}/pages.parquet")
    weights = main_text.learn(pages)
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        assert main_text.main_text(r.html, weights) == " ".join(b for b in blocks if b)
    page = "<header>Site</header><main><h1>T</h1><p>One <b>tw</b>o &amp; <a href=x>three</a><div class='cookie-notice'>no</div><p>four five six</main><section id=comments>bad words here</section>"
    assert main_text.main_text(page, weights) == "T One two & three four five six"
    assert [main_text.main_text(x, weights) for x in (None, "", "<nav>a</nav>", "plain")] == ["", "", "", "plain"]


def test_surroundings_inside_the_marked_content():
    box = "<{0} class='{1}'>" + "these words are no part of the article but stand inside it " * 3 + "</{0}>"
    boxes = "".join(box.format(*x) for x in (("div", "comments"), ("section", "share"), ("div", "ad"), ("aside", "newsletter-box")))
    page = "<nav>Home</nav><article><header><h1>Title {0}</h1></header><p>First words {0}" + " of the text" * 80 + "</p>" + boxes + "<p>Last words {0}" + " of the text" * 80 + "</p></article>"
    weights = main_text.Weights([page.format(i) for i in range(500)])
    assert main_text.main_text(page.format("x").replace("article", "main"), weights) == "Title x First words x" + " of the text" * 80 + " Last words x" + " of the text" * 80
    # the names of elements around the marked content are evidence still
    wrapped = main_text.Weights(["<div class='widget'><article><p>" + "word " * 20 + "</p></article></div>"] * 50)
    assert main_text.main_text("<div class='widget'><p>Some words</p></div>", wrapped) == "Some words"


def test_licences():
    text = "Some words.\nReleased under the MIT License.\nmore\n\n# SPDX-License-Identifier: Apache-2.0 OR MIT\nLicensed under some odd licence of ours."
    assert [x[2] for x in licenses.licences(text)] == ["MIT", "Apache-2.0 OR MIT", "unknown"]
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright\nnotice."
    assert [x[2] for x in licenses.licences(bsd)] == ["BSD-2-Clause"]
    assert licenses.licences(None) == [] and licenses.licences("x" * 300_000 + " license") == []


def test_partial_and_interleaved_licences():
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    as_is = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY."
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
           "Redistributions of source code must retain the above copyright notice.", "Redistributions in binary form must reproduce the above copyright notice."]
    lines = [f"Copyright (c) 20{i:02d} Someone" for i in range(10, 16)]
    hope = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
    names = lambda *parts: [x[2] for x in licenses.licences("\n\n".join(parts))]
    for part in (grant, notice, as_is, hope, lines[0], *bsd):
        assert licenses.licences("Words.\n\n" + part) == [(8, 8 + len(part), "unknown")]
    assert names(grant, *lines, notice, as_is) == ["MIT"] == names(lines[0], lines[1], grant, notice, as_is)
    assert names(grant, bsd[0], notice, bsd[1], bsd[2], as_is) == ["MIT", "BSD-2-Clause"] and names(*bsd, as_is) == ["BSD-2-Clause"]
    assert names(grant, grant, notice, as_is) == ["unknown", "MIT"] and names(grant, notice, *bsd, as_is, "Released under the MIT License.") == ["MIT", "BSD-2-Clause", "MIT"]
    assert names(lines[0], hope, grant, notice) == ["unknown", "unknown", "MIT"]


def test_license_scan(docs, empty):
    assert licenses.scan(docs).count() == 9 and licenses.scan(empty).count() == 0


def test_preferences(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (2, 2, "user", "ok"), (3, 0, None, "x"), (None, 0, "user", "lost")],
        "conv_id long, turn long, role string, text string",
    )
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 3), (9, 1, 99)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in preferences(turns, pairs).collect()}
    a = got[7]
    assert (a.n_common, a.prompt, a.chosen) == (1, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n", "yes<|im_end|>\n")
    assert a.rejected == "<|im_end|>\n<|im_start|>user\nok<|im_end|>\n" and [(m.start, m.end) for m in a.rejected_mask] == [(0, 11)]
    assert (got[8].n_common, got[8].prompt) == (0, "") and [got[8].chosen[m.start : m.end] for m in got[8].chosen_mask] == ["yes<|im_end|>\n"]
    assert got[9].rejected == "" and preferences(turns.limit(0), pairs.limit(0)).count() == 0


def test_prefix_tree_of_very_many_branchings():
    """Three thousand sets that each miss another shingle: the tree branches once for each of them."""
    every = np.arange(3000, dtype=np.int64)
    sets = [np.delete(every, i) for i in range(3000)]
    links = ngram_join.connected(np.arange(3000), sets, 90, 100)
    top = list(range(3000))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        assert len(np.intersect1d(sets[a], sets[b])) * 100 >= 90 * len(np.union1d(sets[a], sets[b]))
        top[find(a)] = find(b)
    assert len({find(i) for i in range(3000)}) == 1


def test_a_response_without_a_length_of_its_own_is_read():
    raw = warc.record("response", "<urn:page:1>", "http://x", b"<p>a</p>", None)
    import gzip
    import re as re_

    whole = gzip.decompress(raw)
    head, _, rest = whole.partition(b"\r\n\r\n")
    block = re_.sub(rb"(?i)content-length: *\d+\r\n", b"", rest[:-4])
    head = re_.sub(rb"(?im)^content-length:[^\r\n]*", b"Content-Length: %d" % len(block), head)
    head = re_.sub(rb"(?im)^warc-block-digest:[^\r\n]*", b"WARC-Block-Digest: sha1:" + warc.base32_sha1(block).encode(), head)
    got = warc.parse(head + b"\r\n\r\n" + block + b"\r\n\r\n")
    assert got["payload"] == b"<p>a</p>" and got["payload_bytes"] == 8 and got["verified"]


def test_very_many_licence_sentences_take_linear_time():
    import time

    def seconds(n):
        text = "\n".join(f"Copyright (c) {1900 + i % 120} Someone {i}" for i in range(n))
        at = time.perf_counter()
        found = licenses.sentences(text)
        assert len(found) == n and [f[0] for f in found] == sorted(f[0] for f in found)
        return time.perf_counter() - at

    seconds(500)
    assert seconds(16_000) < 10 * seconds(4_000) + 1

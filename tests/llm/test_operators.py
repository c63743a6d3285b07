"""Each operator against brute force, an exact round trip, held-out accuracy or its stated results for odd rows."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citeweave.llm import chat_format, common, decontaminate, html_extract, language_id, line_dedup, minhash, mixing, quality_classifier, quality_rules, url_filter
from citeweave.llm.common import shingle_hashes, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, size string"


def invented(n, seed=1):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(("ba", "do", "ki", "lu", "re", "so")) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(12, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and a column whose name clashes."""
    base = invented(12)
    rows = [(i, t, "en", "a" if i % 2 else "b", "x") for i, t in enumerate(base)]
    near = base[3].split()
    near[5] = "other"
    rows += [(20, " ".join(near), "en", "a", None), (21, base[3], None, None, "x"), (21, base[3], None, None, "x"), (None, base[4], "fr", "a", "x"), (22, None, "en", "a", "x"), (23, "", "en", "a", "x"),
             (24, "  \n ", None, "b", "x"), (25, " ".join(invented(200, 2)), "en", "b", "x"), (26, "\n".join([base[5], base[6]]), "en", "b", "x")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_words_agree_with_the_pattern():
    for text in ["", None, " a", "a b c\x0bd\x85e", "w" * 10 + "\n" + "x y"]:
        words = WORD.findall(text or "")
        h, s, e = word_hashes(text)
        data = (text or "").encode()
        assert [data[a:b].decode() for a, b in zip(s, e)] == words
        assert len(set(h.tolist())) == len(set(words))
    long = " ".join(f"word{i}" for i in range(300_000))
    assert len(set(word_hashes(long)[0].tolist())) == 300_000


def test_signatures_estimate_weighted_similarity():
    s = minhash.Settings()
    a, b = np.arange(1, 101, dtype=np.uint64) * np.uint64(7919), np.arange(21, 121, dtype=np.uint64) * np.uint64(7919)
    x, y = minhash.darts([a, b], s)
    assert abs((x == y).mean() - 80 / 120) < 0.12
    w = [np.full(100, 0.5), np.full(100, 2.5)]
    x, y = minhash.darts([a, a], s, w)
    assert abs((x == y).mean() - 0.2) < 0.1


def test_near_duplicates_match_brute_force(spark, odd):
    got = {(r.doc_id, r.h1): r.class_id for r in minhash.near_duplicates(odd.select("doc_id", "text")).collect()}
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    sets = [set(shingle_hashes(word_hashes(t)[0]).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        assert d is None and min(own) == 4 or {v for (k, _), v in got.items() if k == d} == {min(own)}
    kept = minhash.stage_near_dedup(spark, odd, SF)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 21 not in ids and {22, 23, 24, 25} <= set(ids)


def odd_graph():
    """A chain, a hub, a circle, loops, repeated and turned edges and random ones, under shuffled names of either sign; and the least name that each is connected with."""
    rng = random.Random(31)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)]
    edges += [(300, 300), (301, 302), (302, 301), (301, 302)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(140)]
    names = [x - 500 for x in range(1000)]
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    root = {x: x for a, b in edges if a != b for x in (a, b)}
    for a, b in edges:
        if a != b:
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
    return edges, root


@pytest.mark.parametrize("at_once", [common._AT_ONCE, 50])
def test_components_match_brute_force(spark, monkeypatch, at_once):
    """By one task, and by steps where there are more edges than a task connects."""
    monkeypatch.setattr(common, "_AT_ONCE", at_once)
    edges, root = odd_graph()
    scratch = common.Scratch(spark, "components")
    found = common.connected_components(scratch, spark.createDataFrame(edges, "a long, b long").repartition(7), "odd").collect()
    assert len(found) == len(root) and {r.node: r.comp for r in found} == root
    assert common.connected_components(scratch, spark.createDataFrame([], "a long, b long"), "none").collect() == []


def test_a_small_graph_takes_few_jobs(spark):
    """A long chain takes no more of the driver than a pair: before, each step of it had jobs and plans of its own."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        found = common.connected_components(common.Scratch(spark, "components"), edges, "chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.where("comp = 0").count() == 201
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 6


def test_the_driver_gives_native_memory_back(spark):
    assert "rim native heap" in common.trim(spark)


def test_near_duplicates_in_full_buckets_match_brute_force(spark):
    rng = random.Random(23)
    pool = [" ".join(f"p{i}w{k}" for k in range(30)) for i in range(40)]
    texts = [" ".join(p for p in pool if rng.random() < 0.46) for _ in range(300)]
    for t in texts[:40]:
        w = t.split()
        for k in range(4, len(w), len(w) // 7):
            w[k] = "changed"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [set(shingle_hashes(word_hashes(t)[0]).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(root[:], 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    s = minhash.Settings(rows=3, bands=10, loose=0.6, block_docs=4)  # short bands fill the buckets
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.class_id for r in minhash.near_duplicates(df, s).orderBy("doc_id").collect()] == root
    assert len(set(root)) == 300


def test_links_of_near_copies_are_a_forest(spark):
    """Each of 300 near copies meets 20 representatives; as many links as it takes are left, and they connect the same."""
    s = minhash.Settings()
    pairs = [(a, b) for b in range(20, 320) for a in range(20) if (a + b) % 2] + [(1000, 1001)]
    sketch = lambda x: bytes([x % 2 if x < 1000 else 7]) * s.k
    df = spark.createDataFrame([(a, b, sketch(1), sketch(1) if b != 1001 else sketch(0)) for a, b in pairs], "a long, b long, sa binary, sb binary")
    links = [tuple(r) for r in minhash.loose_links(df, s).collect()]

    def classes(links):
        root = {x: x for p in pairs for x in p}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in links:
            root[find(b)] = find(a)
        return {x: min(y for y in root if find(y) == find(x)) for x in root}

    assert set(links) <= set(pairs) and classes(links) == classes(pairs[:-1])
    assert len(links) < 320 + 4 * 20


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    base = invented(25, 7)
    docs = []
    for i in range(40):
        lines = []
        for x in rng.sample(base, 3):
            w = x.split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([["new"], [], [w[k], "more"]])
            lines.append(" ".join(w))
        docs.append((i, "\n".join([*lines, "short one"])))
    s = line_dedup.Settings()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    places = [((d, k), tuple(x.split())) for d, t in docs for k, x in enumerate(t.split("\n")) if len(x.split()) >= 5]
    root = {w: w for _, w in places}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(list(root), 2):
        d = int(s.distance(np.array([min(len(a), len(b))]))[0])
        close = distance(a, b) <= d
        assert close == line_dedup.within(word_hashes(" ".join(a))[0], word_hashes(" ".join(b))[0], d)
        if close:
            root[find(a)] = find(b)
    first = {}
    for p, w in sorted(places):
        first.setdefault(find(w), p)
    expected = {}
    for (d, k), w in places:
        if first[find(w)] != (d, k):
            expected.setdefault(d, []).append(k)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: list(r.lines) for r in line_dedup.repeated_lines(df).collect()}
    assert got == {d: sorted(v) for d, v in expected.items()}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert out == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in expected.get(d, [])) for d, t in docs}


@pytest.mark.parametrize("block", [8, 512])  # hot keys are split, or not
def test_lines_with_a_common_head_match_brute_force(spark, block):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(30)]
    lines = []
    for n in (12, 24):
        head = [f"head{i}" for i in range(n // 2)]
        tails = [rng.sample(pool, n // 2) for _ in range(40)]
        for tail in tails:
            lines.append(tuple(head + tail))
            if rng.random() < 0.6:
                k = rng.randrange(n // 2)
                tail[k : k + 1] = rng.choice([["new"], [], [tail[k], "more"]])
                lines.append(tuple(head + tail))
    rng.shuffle(lines)
    s = line_dedup.Settings(block_lines=block)
    root = {w: w for w in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    hashes = {w: word_hashes(" ".join(w))[0] for w in lines}
    for a, b in itertools.combinations(list(root), 2):
        if line_dedup.within(hashes[a], hashes[b], int(s.distance(np.array([min(len(a), len(b))]))[0])):
            root[find(b)] = find(a)
    seen, expected = set(), set()
    for k, w in enumerate(lines):
        if find(w) in seen:
            expected.add(k)
        seen.add(find(w))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.repeated_lines(df, s).collect()} == expected and len(expected) > 20


def test_line_dedup_of_odd_rows(spark, odd):
    out = line_dedup.stage_line_dedup(spark, odd, SF)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r.doc_id: r.text for r in out.where("doc_id in (22, 26)").collect()} == {22: None, 26: ""}


def test_decontamination(spark, odd):
    items = invented(6, 99)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    other = items[1].split()
    for k in range(2, len(other) - 6, 6):
        other[k] = "changed"
    plant = spark.createDataFrame([(100, f"{invented(1, 3)[0]} {items[0]} {invented(1, 4)[0]}", "en", "a", "x"), (101, " ".join(other), "en", "a", "x")], DOCS)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd.unionAll(plant), bench).collect()}
    assert got == {(100, 0), (101, 1)}
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    a, b = list("abcbdab"), list("bdcaba")
    assert decontaminate.lcs([ord(x) for x in a], [ord(x) for x in b]) == 4


def test_decontamination_of_an_item_in_a_third_of_the_rows(spark):
    rng = random.Random(17)
    items = [*invented(2, 98), " ".join(f"frequent{k}" for k in range(36))]
    rows = []
    for d in range(1500):  # the words beside an item are in one document only
        before, after = ([f"{side}{d}x{k}" for k in range(rng.randrange(90))] for side in "ab")
        held = items[0].split() if d % 3 == 0 else items[1].split() if d == 1000 else []
        if d % 3:
            before += rng.sample(items[2].split(), 20)
        rows.append((d, " ".join([*before, *held, *after])))
    rows.append((1500, " ".join([*(f"c{k}" for k in range(60)), items[2], *(f"d{k}" for k in range(60))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {(d, 0) for d in range(0, 1500, 3)} | {(1000, 1), (1500, 2)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == expected
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, decontaminate.Settings(cells=8)).collect()} == expected


def test_decontamination_matches_brute_force(spark):
    """Documents with edited items against the check of every item at every block of every document."""
    rng = random.Random(31)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = [x for _, t in docs[:80] for x in t.split()]
    for k in range(120):
        w = rng.choice(items)[1].split()
        for j in rng.sample(range(max(0, len(w) - 5)), int(rng.choice([0, 0.1, 0.2, 0.3, 0.45]) * max(0, len(w) - 5))):
            w[j] = rng.choice(some)
        for _ in range(rng.choice([0, 0, len(w) // 10])):
            w.insert(rng.randrange(len(w) - 5), rng.choice(some))
        around = [rng.choice(docs)[1].split()[: rng.randrange(150)] for _ in range(2)]
        docs.append((10_000 + k, " ".join([*around[0], *w, *around[1]])))
    s = decontaminate.Settings()
    hashed = [(i, word_hashes(t)[0]) for i, t in items if t]
    expected = set()
    for d, t in docs:
        w = word_hashes(t)[0]
        for i, item in hashed:
            if np.isin(item, w).mean() >= 0.4:
                found = [decontaminate.holds(item, w, at, s) for at in range(0, max(1, len(w)), s.block)]
                if any(share >= s.sure or share >= s.maybe and answer for share, answer in found):
                    expected.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), decontaminate.Settings(rank=16)).collect()}
    assert len(expected) > 100 and got == expected


def test_svd_keeps_the_space(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(12, 30))
    rows = spark.createDataFrame([(list(range(30)), r.tolist()) for r in m], "cols array<int>, vals array<double>")
    v = decontaminate.randomised_svd(rows, 30, 12, decontaminate.Settings())
    assert np.allclose(m @ v @ v.T, m, atol=1e-6)


def test_mixing(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    caps = {k: 2 * sum(r.size for r in v) for k, v in by.items()}
    order = sorted(by, key=lambda x: (x is None, x or ""))
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    left, open_, target = 1.5 * total, set(order), {}
    while True:  # share what is left, stop those above their caps, share again
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        above = [k for k in open_ if share[k] > caps[k]]
        if not above:
            target |= share
            break
        for k in above:
            target[k] = caps[k]
            left -= caps[k]
            open_.discard(k)
    for k, v in by.items():
        assert abs(v[0].target - target[k]) < 1e-6 and abs(sum(r.taken for r in v) - target[k]) <= 0.5
    again = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(odd).collect())
    assert again == sorted((r.doc_id or -1, r.size, r.taken) for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_rules_match_brute_force(spark, odd):
    text = "a b c a b c x\na b c a b c x\n\n| # y\n"
    df = odd.unionAll(spark.createDataFrame([(50, text, "en", "a", "x")], DOCS))
    out = quality_rules.apply_rules(df, df.where("doc_id < 6").select("doc_id"))
    assert out.count() == df.count()
    for r in out.join(df.select("doc_id", "text"), "doc_id").distinct().collect():
        t = r.text or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + 3)} if len(w) < 2000 else None
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert hit is None or r.n_repeat_words == len(hit)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w)) and not (r.kept and r.base_failed)


def test_urls(spark):
    urls = ["https://A.Example.NET/en/1?x=/de/", "http://example.net/fr/2", "ftp://x.org/fr/", "http://www.example.com/de/a#b", "http://example.com/fr", "http://notexample.com/de/", None, "", "no scheme", "http://org?/fr/", "http://example.net"]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    assert [rows[k].rule for k in range(len(urls))] == ["example.net/en/", "net/", "org/fr/", "example.com/de/", None, None, None, None, None, None, None]
    assert (rows[0].host, rows[0].path, rows[0].verdict) == ("a.example.net", "/en/1", "allow")
    assert (rows[6].host, rows[6].path, rows[9].host, rows[9].path) == ("", "", "org", "")
    assert {rows[k].verdict for k in rows} <= {"allow", "block"}


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "####</turn></turn>\n\\", "\\\\", "", None, ": x", "### user: y</turn>\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "a: b\\", None, "assistant", "</turn>:", "assistant"], nasty))]
    rows += [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_trees(spark, chat_format.turn_trees(df))
    from pyspark.sql import functions as F

    got = {r.tree: r for r in out.select("tree", "formatted", "loss_spans", chat_format.turns_of(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(x.role, x.text) for x in got[1].t] == [(r or "", t or "") for _, _, r, t in rows[:7]]
    assert got[1].loss == "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant")
    assert len(got[2].t) == 2 and [(x.role, x.text) for x in got[None].t] == [("assistant", "z")]


def test_chat_branches(spark):
    nodes = spark.createDataFrame(
        [(1, None, 7, "user", "q", 0.0), (2, 1, 7, "assistant", "bad", 0.1), (3, 1, 7, "assistant", "good", 0.9), (4, 3, 7, "user", "more", 0.5), (5, 99, 8, "user", "lone", None)],
        "node long, parent long, tree long, role string, text string, score double",
    )
    got = {r.tree: r.formatted for r in chat_format.format_trees(spark, nodes).collect()}
    assert got == {7: "### user: q</turn>\n### assistant: good</turn>\n### user: more</turn>\n", 8: "### user: lone</turn>\n"}


def test_html():
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article><h1>Head &amp; tail</h1><p>A first  paragraph of words,\nwith some more of them.</p><script>var x="<p>no</p>";</script><p>And a second one &lt;b&gt; here, which is long enough.<p>Unclosed third one is here too, as text.</article><div class="comments"><p>Nice text, I liked it a lot.</p></div><footer>&copy; all</footer></body></html>'
    found = html_extract.blocks(page)
    assert [b.text for b in found] == ["Home", "News", "Head & tail", "A first paragraph of words, with some more of them.", "And a second one <b> here, which is long enough.", "Unclosed third one is here too, as text.", "Nice text, I liked it a lot.", "© all"]
    assert html_extract.blocks(None) == [] and html_extract.blocks("<p") != [None]
    weights = html_extract.train(html_extract.Settings(pages=250, epochs=5))
    p = html_extract.probabilities([found], weights)[0]
    assert (p >= 0.5).tolist() == [False, False, True, True, True, True, False, False]
    fresh = [(html_extract.blocks(x), y) for x, y in html_extract.training_pages(60, 5)]
    scores = html_extract.probabilities([x for x, _ in fresh], weights)
    assert np.mean(np.concatenate([(s >= 0.5) == np.array(y, bool) for s, (_, y) in zip(scores, fresh)])) > 0.95


def test_html_vectors_read_whole_blocks():
    long = [html_extract.blocks(f"<p>{'same ' * 300}{w * 300}</p>") for w in ("one ", "two ")]
    x, y = (html_extract.vectors(b)[0, html_extract.PATH : html_extract.PATH + html_extract.WORDS] for b in long)
    assert np.allclose(np.sort(x)[-2:], 0.5**0.5) and not np.allclose(x, y)


def test_html_in_stretches_is_as_whole(monkeypatch):
    found = [html_extract.blocks(x) for x, _ in html_extract.training_pages(12, 9)]
    weights = html_extract.train(html_extract.Settings(pages=40, epochs=1))
    whole = html_extract.probabilities(found, weights)
    monkeypatch.setattr(html_extract, "_HELD", 5)  # every page is read in stretches
    for x, y in zip(whole, html_extract.probabilities(found, weights)):
        assert np.allclose(x, y, atol=1e-5)


@pytest.mark.parametrize("page, expected", [
    ("<html><head><title>t</title><body><p>one</p><div>two</div>", ["one", "two"]),
    ("<head><meta charset=x><p>one", ["one"]),
    ('<head><script>var s="<!--";</script></head><body><p>a</p></body>', ["a"]),
    ("<p>x</p><script>a</script foo><p>rest</p>", ["x", "rest"]),
    ('<head><script>var x="</head>"; foo()</script></head><p>y</p>', ["y"]),
    ("foo<img>bar <b>x</b>y<br>z", ["foobar xy z"]),
    ("<ul><li>a<div><p>b</div><li>c<ul><li>d</ul>e</ul><table><tr><td>1<td>2<tr><td>3</table>", ["a", "b", "c", "d", "e", "1", "2", "3"]),
    ("<svg><title>q</title><p>after", ["after"]),
    ("a < b <3 &amp; c <x", ["a < b <3 & c <x"]),
    ("<noscript><p>one</p>", ["one"]),
    ("<select><option>o<p>t", ["t"]),
    ("<p>a<!-- b --> c<!--> d<!-- never ended <p>e", ["a c d"]),
    ("<p title='it>x'>a</p><p title=it's>b", ["a", "b"]),
])
def test_odd_html(page, expected):
    assert [b.text for b in html_extract.blocks(page)] == expected


def test_deep_and_broken_html_takes_linear_time():
    start = time.time()
    deep = html_extract.blocks("<div>x " * 100_000)
    assert len(deep) == 100_000 and html_extract.vectors(deep, 99_000).shape == (1000, html_extract.N)
    for page in ("<noscript>" * 100_000, "<a b='" * 50_000 + ">", "<i class=x><div>" + "<span class=y>" * 20_000 + "</i>" * 20_000, "<" * 200_000, "<!--" * 100_000):
        html_extract.blocks(page)
    assert time.time() - start < 60


def test_html_rows(spark):
    html = "<nav><a href=x>Home</a></nav><article><h1>A head line</h1><p>Some words of text, and then some more of them.</p></article>"
    rows = spark.createDataFrame([(1, html, "u"), (1, html, "u"), (2, None, None), (None, "", "u"), (3, "<li>x" * 30_000, "u")], "page_id long, html string, text string").repartition(2)
    weights = html_extract.train(html_extract.Settings(pages=250, epochs=5))
    out = html_extract.extract(rows, weights)
    assert out.columns == ["page_id", "html", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in out.where("page_id is null or page_id < 3").collect())
    one = "A head line\n\nSome words of text, and then some more of them."
    assert got == [(0, "", 0), (1, one, len(one)), (1, one, len(one)), (2, "", 0)]
    assert html_extract.extract(rows.limit(0), weights).count() == 0 and out.count() == 5


def test_language_and_quality_on_held_out_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_classifier.op6_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.quality == r.predicted for r in out]) > 0.95
    model = language_id.fit([], language_id.Settings(buckets=64))
    assert model.predict("abc") == ("und", 0.0, False) and language_id.identify(odd, model).count() == odd.count()
    m = quality_classifier.train(odd, labels.limit(0))
    assert {r.score for r in quality_classifier.classify(odd, m).collect()} == {0.5}


def test_a_language_whose_rows_repeat_is_learned(spark):
    en, fr = invented(300, 4), "les mots de la langue se suivent ici et tous sont pareils"
    rows = [(i, t, "en") for i, t in enumerate(en)] + [(1000, fr, "fr")] * 20_000 + [(2000 + i, None, "de") for i in range(5)] + [(3000, "x", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language_id.Settings(buckets=4096, rows_per_language=50))
    assert model.languages == ["en", "fr"] and model.predict(fr)[0] == "fr" and model.predict(en[7])[0] == "en"
    many = [(i, f"{t} l{i % 300}", f"l{i % 300}") for i, t in enumerate(invented(900, 6))]  # more languages than the sample has room for
    few = language_id.train(spark.createDataFrame(many, "doc_id long, text string, lang string"), language_id.Settings(buckets=256, sample_rows=200, epochs=1))
    assert len(few.languages) == 300


def spark_hash(*parts):
    """Spark's xxhash64 of strings and ints."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(4, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_log_ratios_match_brute_force(spark, odd):
    s = quality_rules.Settings(buckets=512)
    long = [(60 + i, " ".join(invented(3, 40 + i)), "en", "a", "x") for i in range(12)]
    df = odd.unionAll(spark.createDataFrame(long, DOCS))
    trusted = df.where("doc_id between 60 and 65").select("doc_id")
    rows = df.select("doc_id", "text").collect()

    def grams(t):
        w = WORD.findall(t or "")
        return [spark_hash(x) % 512 for x in w] + [spark_hash(x, y) % 512 for x, y in zip(w, w[1:])]

    raw, good = np.zeros(512), np.zeros(512)
    for r in rows:
        np.add.at(raw, grams(r.text), 1)
        if r.doc_id is not None and 60 <= r.doc_id <= 65:
            np.add.at(good, grams(r.text), 1)
    ratio = np.log((good + 1) / (good.sum() + 512)) - np.log((raw + 1) / (raw.sum() + 512))
    llr = {(r.doc_id, r.text): float(np.mean(ratio[grams(r.text)])) if grams(r.text) else 0.0 for r in rows}
    cut = np.quantile([llr[r.doc_id, r.text] for r in rows if r.doc_id is not None and 60 <= r.doc_id <= 65], s.trusted_loss) - s.slack
    out = quality_rules.apply_rules(df, trusted, s).join(df.select("doc_id", "text"), "doc_id").distinct().collect()
    seen = set()
    for r in out:
        seen.add(r.kept)
        assert abs(r.llr - llr[r.doc_id, r.text]) < 1e-9 and r.kept == (not r.base_failed and llr[r.doc_id, r.text] >= cut)
    assert seen == {True, False}


def test_rules_count_all_trusted_documents(spark):
    """Where all documents are trusted, the target's counts are the raw ones, whatever their number."""
    text = F.concat_ws(" ", F.lit("the words of"), F.concat(F.lit("w"), F.col("id") % 1009), F.concat(F.lit("x"), F.col("id") % 4001))
    df = spark.range(20_500).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert quality_rules.apply_rules(df, df.select("doc_id")).where("abs(llr) > 1e-12").isEmpty()


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_rows_around_a_sum_of_weights(spark, most):
    rng = random.Random(5)
    rows = [(float(rng.choice([rng.randint(-3, 3), rng.gauss(0, 1), 1e6])), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1)], "x double, y int").cache()
    for weights in ((0.0, 1.0), (1.0, 3.0)):
        total = sum(weights[y] for _, y in rows)
        for share in (0.003, 0.3, 0.5, 0.8, 1.0):
            target = int(share * total) + 1 if share < 1 else total
            order, sums = sorted(rows), np.cumsum([weights[y] for _, y in sorted(rows)])
            at = int(np.searchsorted(sums, target))
            assert common.around(df, weights, target, most) == (order[at][0], order[min(at + 1, 299)][0])
    assert common.around(df.limit(0), (0.0, 1.0), 1) is None and common.quantile(df.limit(0), 0.5) is None
    assert common.quantile(df, 0.37) == pytest.approx(np.quantile([x for x, _ in rows], 0.37), abs=1e-12)


def test_url_models_learn_from_all_urls(spark):
    s = url_filter.Settings(buckets=4096, order=0)
    urls = [f"http://example.net/en/{'abcdefgh'[i % 8] * (i % 5)}{i}" for i in range(20_500)] + [f"http://x.net/{i}" for i in range(10)]
    rows = url_filter.judge(spark.createDataFrame([*enumerate(urls), (-1, "http://b.com/9")], "page_id int, url string"), s=s).where("page_id < 2").collect()
    chars = {v: {} for v in ("allow", "block")}
    for u in urls:
        if spark_hash(u, s.seed + 1) % s.folds:
            for c in u:
                own = chars["allow" if "/en/" in u else "block"]
                own[c] = own.get(c, 0) + 1
    counts = {v: np.zeros(s.buckets) for v in chars}
    for v, found in chars.items():
        counts[v][spark_hash(0, "") % s.buckets] += sum(found.values())
        for c, n in found.items():
            counts[v][spark_hash(1, c) % s.buckets] += n
    context = spark_hash(0, "") % s.buckets
    p = lambda v, c: (counts[v][spark_hash(1, c) % s.buckets] + s.strength / s.alphabet) / (counts[v][context] + s.strength)
    assert len(rows) == 3
    for r in rows:
        assert abs(r.llr - np.mean([np.log(p("allow", c) / p("block", c)) for c in r.url])) < 1e-9


def test_url_verdicts_match_brute_force(spark):
    s = url_filter.Settings(buckets=4096, order=2)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    urls = [f"https://{word()}.{rng.choice(['net', 'org', 'com', 'example.net', 'example.com'])}/{rng.choice(['en', 'fr', 'de'])}/{word()}" for _ in range(300)]
    urls += urls[:20] + [None, "", "x", "http://a"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), s=s).collect()
    ruled = {r.url: r.verdict for r in rows if r.basis == "rule"}
    tune = {u for u in ruled if spark_hash(u, s.seed + 1) % s.folds == 0}

    def grams(u):
        t = "\x01" * s.order + u
        return [[spark_hash(2 * n + more, t[i - n : i + more]) % s.buckets for n in range(s.order + 1) for more in (0, 1)] for i in range(s.order, len(t))]

    counts = {v: np.zeros(s.buckets) for v in ("allow", "block")}
    for u, v in ruled.items():
        if u not in tune:
            np.add.at(counts[v], [b for g in grams(u) for b in g], 1)

    def llr(u):
        total = 0.0
        for g in grams(u):
            p = dict.fromkeys(counts, 1.0 / s.alphabet)
            for n in range(s.order + 1):
                p = {v: (counts[v][g[2 * n + 1]] + s.strength * p[v]) / (counts[v][g[2 * n]] + s.strength) for v in p}
            total += np.log(p["allow"]) - np.log(p["block"])
        return total / len(u) if u else 0.0

    cut = min(0.0, np.quantile([llr(u) for u in tune if ruled[u] == "allow"], s.accepted_loss))
    by_model = [r for r in rows if r.basis == "model"]
    assert {r.verdict for r in by_model} == {"allow", "block"}
    for r in rows:
        assert abs(r.llr - llr(r.url or "")) < 1e-9
    for r in by_model:
        assert r.verdict == ("allow" if llr(r.url or "") >= cut - 1e-12 else "block")


def test_quality_score_is_the_pairs_logistic(spark):
    """The learned weights order held-out pairs, and the score is the logistic of the distance from the cut."""
    s = quality_classifier.Settings(pairs=2000, epochs=2)
    good = [". ".join(invented(3, 100 + i)) + "." for i in range(60)]
    bad = ["### $$$ " * (5 + i % 9) + "a a a a" for i in range(60)]
    x = np.array([quality_classifier.features(t, s) for t in good[:40] + bad[:40]])
    m = quality_classifier.fit(x, np.array([1] * 40 + [0] * 40), s)
    raw = lambda t: float((quality_classifier.features(t, s) - m.centre) @ m.weights)
    assert all(raw(a) > raw(b) for a, b in zip(good[40:], bad[40:]))
    for t in good[40:] + bad[40:] + ["", None]:
        assert abs(m.score(t) - 1 / (1 + np.exp(-np.clip((raw(t) - m.cut) / m.scale, -30, 30)))) < 1e-12
    df = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (None, good[0], None), (3, "x " * 300_000, "s")], "doc_id long, text string, score string").repartition(2)
    out = quality_classifier.classify(df, m)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 4


@pytest.mark.parametrize("n_good, n_bad", [(70, 60), (70, 3)])
def test_quality_learns_from_all_labelled_rows(spark, n_good, n_bad):
    """Weights and cut come from all labelled rows, in blocks of few; the one bad text of a kind of its own is learned too."""
    s = quality_classifier.Settings(rows_per_label=20, pairs=500, epochs=3)
    good = [". ".join(invented(2, 100 + i)) + "." for i in range(n_good)]
    bad = ["a | = | " * (6 + i % 7) + f"z {i}" for i in range(n_bad)]
    rows = [(i, t, int(i < n_good)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, quality int").repartition(3)
    m = quality_classifier.train(df, df, s)
    x = np.array([quality_classifier.features(t, s) for _, t, _ in rows])
    raw = np.sort((x - m.centre) @ m.weights)
    assert m.cut == pytest.approx((raw[n_bad - 1] + raw[n_bad]) / 2, abs=1e-9) and m.scale == pytest.approx(raw.std() / 4, rel=1e-9)
    assert [int(m.score(t) >= 0.5) for _, t, _ in rows] == [q for _, _, q in rows]
    again = quality_classifier.train(df.repartition(2), df, s)
    assert (again.weights == m.weights).all() and again.cut == m.cut
    only = quality_classifier.train(df, df.where("quality = 1"), s)
    assert only.score(good[0]) > 0.5


def test_empty_tables(spark, odd):
    """Every operator gives no rows for an empty table."""
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert language_id.identify(none, language_id.train(none, language_id.Settings(buckets=64))).count() == 0
    assert quality_classifier.classify(none, quality_classifier.train(none, labels)).count() == 0
    assert quality_rules.apply_rules(none, none.select("doc_id")).count() == 0 and mixing.mix(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0 and minhash.stage_near_dedup(spark, none, SF).count() == 0
    assert url_filter.judge(pages.select("page_id", "url")).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.stage_decontaminate(spark, none, SF).count() == 0
    assert chat_format.format_trees(spark, chat_format.turn_trees(talks)).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_clashing_names_and_very_long_texts(spark):
    """Columns named as the operators name theirs inside, and a text of megabytes with many lines."""
    words = invented(40, 12)
    long = "\n".join(f"{words[k % 40]} {k}" for k in range(30_000))
    extra = "doc_id long, text string, lang string, source string, h1 long, h_ long, row string, node long, comp long, gone_ string, n_removed string, score string, kept string, size string"
    rest = (7, 7, "x", 7, 7, "x", "x", "x", "x", "x")
    rows = [(1, long, "en", "a", *rest), (2, words[0], "en", "a", *rest), (2, words[0], "en", "a", *rest), (None, None, None, None, *rest[:-1], None), (4, long + " end", "en", "b", *rest)]
    df = spark.createDataFrame(rows, extra).repartition(2)
    lines = line_dedup.stage_line_dedup(spark, df, SF)
    assert lines.columns == df.columns and lines.count() == 5
    near = minhash.stage_near_dedup(spark, df, SF)
    assert near.columns == df.columns and sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 2]
    assert decontaminate.stage_decontaminate(spark, df, SF).columns == df.columns
    assert {r.taken is None for r in mixing.mix(df).collect()} == {False}
    rules = quality_rules.apply_rules(df, df.select("doc_id"))
    assert {r.n_words for r in rules.where("doc_id in (1, 4)").collect()} == {len(long.split()), len(long.split()) + 1}
    langs = language_id.identify(df, language_id.train(df, language_id.Settings(buckets=4096, epochs=2)))
    assert {(r.doc_id, r.lang_pred) for r in langs.collect()} == {(1, "en"), (2, "en"), (None, "und"), (4, "en")}


def test_chat_rows_with_clashing_names(spark):
    rows = [(1, 0, "user", "a", 5, 6, "x"), (1, 1, "assistant", "b", 5, 6, "x"), (None, 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node long, tree long, leaf string")
    got = {r.tree: r.formatted for r in chat_format.format_trees(spark, chat_format.turn_trees(df)).collect()}
    assert got == {1: "### user: a</turn>\n### assistant: b</turn>\n", None: "### : </turn>\n"}


def test_digest(spark):
    row = chat_format.op9_chat_format(spark, SF).where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()

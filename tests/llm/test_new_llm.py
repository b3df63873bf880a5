"""Conversation trie, collocations and page text against brute force on small fixtures."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import pytest

from tesserae.llm import collocations, conversation_trie, page_diff, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = ", key string, comp string, n long, lines string"


def wide(spark, rows, schema, partitions=5):
    """Further columns carry the names that the operators use themselves."""
    return spark.createDataFrame([(*r, "k", "c", 7, "l") for r in rows], schema + EXTRA).repartition(partitions)


def brute_trie(rows):
    conv = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in conv.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    node = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            node[tuple(turns[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in node if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in node.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += kids[k] == 0
    out = []
    for k, m in node.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        out.append((min(m), len(k), min(node[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def turns():
    r = random.Random(3)
    rows = [(None, 1, "u", "x"), (3, None, "u", "n"), (3, 0, None, None), (3, 0, None, None), (-7, 2, "a", "b"), (-7, 1, "a", "é"), (-5, 1, "a", "é")]
    for c in range(60, 100):
        rows += [(c, t, r.choice("ua"), r.choice(["x", "y", ""])) for t in range(r.randint(1, 12))]
    for c, n in ((205, 400), (206, 250)):  # two long paths with much in common, most of all turns
        rows += [(c, t, "u", f"long {t % 3}") for t in range(n)]
    return rows


@pytest.mark.parametrize("limit", [60, conversation_trie.LIMIT])
def test_trie(spark, turns, limit):
    df = wide(spark, turns, "conv_id long, turn long, role string, text string", 7)
    got = sorted((tuple(r)[:8] for r in conversation_trie.prefix_trie(df, limit=limit).collect()), key=str)
    assert got == brute_trie(turns)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(df).count() == 0
    only_null = spark.createDataFrame([(None, 0, "u", "x")], df.schema)
    assert conversation_trie.prefix_trie(only_null).count() == 0


def test_centroid_split_of_a_path_and_a_star():
    n = 2000
    path, star = [-1, *range(n - 1)], [-1] + [0] * (n - 1)
    ones = lambda: [1] * n
    assert conversation_trie._split(path, list(range(n, 0, -1)), [0], [ones()], [[0] * n]) == [list(range(n, 0, -1))]
    assert conversation_trie._split(star, [n] + [1] * (n - 1), [0], [ones()], [[5] + [0] * (n - 1)]) == [[n + 5] + [1] * (n - 1)]


def brute_phrases(rows, least, first, covered):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        longest = collections.Counter()
        for p, a in c.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longest[q] = max(longest[q], a)
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longest[p] and 100 * longest[p] >= covered * a):
                score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        found.sort()
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(found[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["THE", "the", "Été", "été", "a b", "x-y"]
    marks = ["", "", "", "", ".", ",", "\n", "!", ";"]
    rows = [(None, None), ("en", ""), ("en", " . "), ("und", "the the the. " * 30), (None, "the the the, " * 20)]
    for i in range(120):
        text = " ".join(r.choice(words[: r.choice([4, 46])]) + r.choice(marks) for _ in range(r.randint(1, 120)))
        rows.append((r.choice(["en", "de", None]), text))
    return rows + rows[-30:] + [("en", "hot pair\t" * 30_000)]


@pytest.mark.parametrize("head,first", [(collocations.HEAD, 2000), (7, 20)])
def test_collocations(spark, phrases, head, first):
    df = wide(spark, phrases, "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(df, first=first, head=head).collect())
    assert got == brute_phrases(phrases, 10, first, 50)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_crowded_tiles_are_counted_as_sparse_ones():
    import numpy as np

    r = np.random.default_rng(1)
    i, j = r.integers(0, 30, 600_000), np.minimum(r.integers(0, 3000, 600_000), r.integers(0, 3000, 600_000))
    s = r.integers(0, 2**63, 3000, dtype=np.uint64)
    total = collections.Counter()
    for batch in collocations._tiles(*collocations._codes(s[i], s[j], i, j), 0, 4):
        for row in batch.to_pylist():
            a, b = divmod(row["tile"], collocations.HEAD // collocations.SIDE)
            for cell, n in zip(np.frombuffer(row["left"], np.uint32).tolist(), np.frombuffer(row["n"], np.uint32).tolist()):
                total[a * collocations.SIDE + cell // collocations.SIDE, b * collocations.SIDE + cell % collocations.SIDE] += n
    assert np.bincount(j // collocations.SIDE).max() > collocations.CROWDED
    assert total == collections.Counter(zip(i.tolist(), j.tolist()))


def test_partial_tiles_are_added_in_steps(spark, phrases, monkeypatch):
    monkeypatch.setattr(collocations, "FAN_IN", 2)
    got = sorted(tuple(r) for r in collocations.collocations(wide(spark, phrases, "lang string, text string", 6), head=9).collect())
    assert got == brute_phrases(phrases, 10, 2000, 50)


def test_longest_common_subsequence(monkeypatch):
    r = random.Random(1)

    def length(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for bits in (page_diff.ROWS_BITS, 20):
        monkeypatch.setattr(page_diff, "ROWS_BITS", bits)
        for _ in range(800):
            x, y = ([r.randrange(6) for _ in range(r.randrange(16))] for _ in "xy")
            p = page_diff.common(x, y)
            assert len(p) == length(x, y) and all(x[i] == y[j] for i, j in p)
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(p, p[1:]))


def test_lines_of_a_page():
    page = (
        '<body class="no-sidebar"><header>Top <b>x</b></header><div class="ad">buy<p>now</div><p>a &amp;amp; b<br>c  d<ul><li>d<li>e</ul><p class=notice>n<p>f'
        '<article><header class="entry-header"><h1>T</h1></header>x<!-- c --><p>y<script>"</p>"</script>z <div id="userComments">q</div> w <i class="ad">u</i>v</article>'
        '<footer>foo <a title="a>b">b'
    )
    assert page_diff.lines(page) == [
        ("Top x", 0), ("buy", 0), ("now", 0), ("a &amp; b c d", 1), ("d", 1), ("e", 1), ("n", 0), ("f", 1),
        ("T", 2), ("x", 2), ("y z", 2), ("q", 0), ("w", 2), ("u", 0), ("v", 2), ("foo b", 0),
    ]
    for odd in ("", "<", "<p", "<p class='x", "<!-- never closed <p>x", "<script>x", "</p></article>", "a < b > c &am", '<a href="x'):
        page_diff.lines(odd)
    assert page_diff.lines("a &lt b &#233; &am") == [("a < b é &am", 1)]


def plain(i, lines):
    """A page without any element that says what it is."""
    return f"<html><body><div>Acme news</div><div>Home | World</div>{''.join(f'<div>{x}</div>' for x in lines)}<div>All rights reserved</div></body></html>"


def test_shared_lines_go_and_copies_stay(spark):
    bodies = {i: [f"story {i} line {k} with words of its own" for k in range(6)] for i in range(40)}
    rows = [(i, f"https://News.example.com/a/{i:03d}?q={i}", plain(i, x)) for i, x in bodies.items()]
    rows += [(100, "http://other.example/x", plain(0, ["alone"])), (101, None, None), (102, "no scheme", "<p>text</p>"), (103, "http://third.example/", "")]
    # Two copies of a whole page of another host, and an article that repeats on neighbours.
    rows += [(110 + k, f"http://copy.example/{k}", plain(0, ["same words here", "and there"])) for k in (0, 1)]
    rows += [(120 + k, f"http://mag.example/{k}", f"<nav>Menu</nav><article><h1>T{k}</h1><p>shared license line</p></article>") for k in (0, 1, 2)]
    for partitions in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = {r.page_id: r for r in page_diff.main_text(wide(spark, rows, "page_id long, url string, html string")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
        for i, x in bodies.items():
            assert got[i].text == " ".join(x)
        assert got[100].text == "Acme news Home | World alone All rights reserved"
        assert (got[101].text, got[101].url, got[102].text, got[103].text) == ("", None, "text", "")
        assert got[110].text == got[111].text == "Acme news Home | World same words here and there All rights reserved"
        assert [got[120 + k].text for k in range(3)] == [f"T{k} shared license line" for k in range(3)]


def test_repeated_rows_of_a_hot_url(spark):
    rows = [(5, "http://a.example/1", plain(0, ["one of a kind", "more of it, long enough"]))] * 50 + [(4, "http://a.example/0", plain(0, ["another story", "quite different from that"]))]
    got = page_diff.main_text(wide(spark, rows, "page_id long, url string, html string")).groupBy("page_id", "text").count().collect()
    assert sorted(map(tuple, got)) == [(4, "another story quite different from that", 1), (5, "one of a kind more of it, long enough", 50)]
    assert page_diff.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in queries.QUERIES["op13_html_extraction"](spark, "/root/testdata/sf0.001").collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        assert got[page.page_id] == " ".join(html.unescape(re.sub("<[^>]+>", " ", article)).split())


def test_co_training_uses_every_unlabelled_document(spark, monkeypatch):
    from tesserae.llm import quality_classifier

    r = random.Random(8)
    good, bad = ["plain", "honest", "words", "river"], ["$$$", "###", "win", "cash"]
    rows = [(i, " ".join(r.choices(good if i % 2 else bad, k=12)) + f" t{r.randrange(50)}", "en", "web", 40) for i in range(8000)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    seen, plain = [], quality_classifier.co_train
    monkeypatch.setattr(quality_classifier, "co_train", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = quality_classifier.quality_scores(docs, marks).collect()
    assert len(got) == 8000 and all(g.keep == bool(g.doc_id % 2) for g in got)
    # The text view is sure of nearly all 7,600 unlabelled documents and teaches them to the other view.
    assert min(counts["meta"] for counts in seen[0][1]) > 7000


def test_gradients_of_many_tasks_are_added_in_steps(spark, monkeypatch):
    import numpy as np

    from tesserae.llm import quality_classifier as qc

    monkeypatch.setattr(qc, "FAN_IN", 3)
    rows = [(b, p, np.full(4, float(p + 10 * b)).tobytes()) for b in range(2) for p in range(20)]
    total = qc._summed(spark.createDataFrame(rows, "block int, part int, values binary").repartition(5), 20)
    assert total.tolist() == [190.0] * 4 + [390.0] * 4


def test_overlaps_as_long_as_the_item(spark):
    from tesserae.llm import decontaminate

    r = random.Random(4)
    noise = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    item = [f"b{i}" for i in range(200)]
    changed = [f"z{i}" if i % 9 == 4 else w for i, w in enumerate(item)]
    chinese = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(30))
    rows = [(1, " ".join(noise(30) + item + noise(30))), (2, " ".join(noise(7) + changed + noise(7))), (3, " ".join(item[:70] + noise(40) + item[110:])), (4, "前文" + chinese + "。后文"), (5, "".join(reversed(chinese))), (6, None), (7, "")]
    # Rows that share a doc_id are not laid over each other.
    rows += [(8, " ".join(item[:30])), (8, " ".join(["x"] * 30 + item[30:60]))]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, chinese)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.id, x.item_id): x for x in decontaminate.overlaps(docs, bench).collect()}
    assert sorted(got) == [(1, 10), (2, 10), (3, 10), (4, 11), (8, 10)]
    assert (got[1, 10].words, got[1, 10].agree, got[1, 10].first_word, got[1, 10].last_word) == (200, 200, 30, 229)
    assert got[2, 10].words >= 200 and got[2, 10].agree == sum(a == b for a, b in zip(item, changed))
    assert 90 <= got[3, 10].words <= 115 and got[4, 11].words >= 30 and got[8, 10].words < 50
    assert [x.id for x in decontaminate.overlaps(docs, bench, min_words=150).collect() if x.item_id == 10] and {x.id for x in decontaminate.overlaps(docs, bench, min_words=150).collect() if x.item_id == 10} == {1, 2}


def test_longest_stretch_against_brute_force():
    import numpy as np

    from tesserae.llm import decontaminate

    r = random.Random(6)
    for _ in range(400):
        bits = np.array([r.random() < 0.75 for _ in range(r.randint(1, 25))], np.uint8)
        want = max(((b - a, -a) for a in range(len(bits)) for b in range(a + 1, len(bits) + 1) if bits[a:b].sum() >= 0.8 * (b - a) - 1e-9), default=(0, 0))
        start, words = decontaminate.longest(bits, 0.8)
        assert words == want[0] and (not words or start == -want[1])

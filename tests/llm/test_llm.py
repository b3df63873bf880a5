"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import decontaminate, exact_dedup, jaccard_join, lm_scoring, packing, quality_classifier, queries, substring_dedup, suffix_dedup, token_counts, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def corpus(seed=1, n=40):
    """Texts that repeat and vary each other."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Äh", "été", "THE", "the", "x,y"]
    base = [" ".join(r.choices(words, k=r.randint(60, 160))) for _ in range(6)]
    rows = [(None, "null id " + base[0]), (3, None), (4, ""), (5, " \n"), (6, "one"), (7, "One"), (8, "one two"), (9, " ".join(r.choices(words, k=9000)))]
    for i in range(10, n):
        w = r.choice(base).split()
        if r.random() < 0.7:
            for _ in range(r.randint(1, 6)):
                w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            k = r.randrange(len(w))
            w = w[:k] + r.choice(base).split()[:70] + w[k:]
        rows.append((i, " ".join(w)))
    return rows + rows[12:14] + [(50, base[1]), (51, base[1].upper()), (11, base[2])]


def test_exact_dedup(make):
    rows = corpus()
    norm = [(d, (t or "").translate(LOW)) for d, t in rows]
    for table_bytes in (exact_dedup.TABLE_BYTES, 300):  # the small table makes buckets divide again and again
        got = exact_dedup.exact_dedup(make(rows), table_bytes=table_bytes, fanout=3).collect()
        assert len(got) == len(rows)
        by = {}
        for d, t in norm:
            by.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(d)
        for g in got:
            ids = by[g.text_sha256]
            assert g.group_size == len(ids) and g.keep_id == max((i for i in ids if i is not None), default=None)
        kept = [g for g in got if g.kept]
        assert sorted(g.text_sha256 for g in kept) == sorted(by) and all(g.doc_id == g.keep_id for g in kept)
    stay = exact_dedup.kept_rows(make(rows))
    assert stay.columns == make(rows).columns and stay.count() == len(by)
    assert exact_dedup.exact_dedup(make([(1, "a")]).limit(0)).count() == 0


def test_text_table_compares_contents():
    table = exact_dedup.TextTable(4)
    assert [table.find(7, t) for t in ("a", "b", "a", "c", "b")] == [0, 1, 0, 2, 1]


def brute_repeats(rows, units, window):
    """(doc_id, text) -> {(doc_id, text): (n, removed mask)} for sequences units(text)."""
    first = {}
    key = lambda d: 2**63 - 1 if d is None else d
    for d, t in rows:
        u = units(t)
        for i in range(len(u) - window + 1):
            w = tuple(u[i : i + window])
            first[w] = min(first.get(w, 2**63 - 1), key(d))
    out = {}
    for d, t in rows:
        u, gone = units(t), [False] * len(units(t))
        for i in range(len(u) - window + 1):
            if first[tuple(u[i : i + window])] < key(d):
                gone[i : i + window] = [True] * window
        out[d, t] = (u, gone)
    return out


@pytest.mark.parametrize("window,period", [(50, 31), (8, 3), (5, 5), (6, 1)])
def test_substring_dedup(make, window, period):
    rows = corpus(2)
    want = brute_repeats(rows, lambda t: WORD.findall(t or ""), window)
    expected = sorted((str(d), len(u), sum(g), " ".join(w for w, x in zip(u, g) if not x)) for (d, t) in rows for u, g in [want[d, t]])
    got = substring_dedup.substring_dedup(make(rows), window, period).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == expected


@pytest.mark.parametrize("period", [1, 2, 7, 13, 31, 40])
def test_difference_cover(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_suffix_dedup(make):
    rows = [(d, t if t is None or len(t) < 5000 else t[:1500]) for d, t in corpus(3)]
    want = brute_repeats(rows, lambda t: (t or "").encode(), 50)
    expected = sorted((str(d), len(u), sum(g), bytes(w for w, x in zip(u, g) if not x)) for (d, t) in rows for u, g in [want[d, t]])
    got = suffix_dedup.suffix_dedup(make(rows), per_bucket=500).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == expected
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_suffix_array():
    r = np.random.default_rng(1)
    for trial in range(120):
        t = r.integers(97, 97 + int(r.integers(1, 4)), int(r.integers(0, 200))).astype(np.uint8)
        t = np.tile(t[: len(t) // 5], 5) if trial % 3 == 0 else t
        b = t.tobytes()
        order = suffix_dedup.suffix_array(t, 50)
        assert sorted(order.tolist()) == list(range(len(b)))
        assert [b[i : i + 50] for i in order] == sorted(b[i : i + 50] for i in range(len(b)))


@pytest.mark.parametrize("words,percent,short", [(3, 90, 12), (5, 80, 12), (1, 70, 2), (2, 50, 2)])
def test_jaccard_classes(make, words, percent, short):
    rows = corpus(4, 60)
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(2**63 if d is None else d)
    want = sorted((str(d), len(sets[i]), str(None if min(least[root(i)]) == 2**63 else min(least[root(i)]))) for i, (d, _) in enumerate(rows))
    got = jaccard_join.jaccard_classes(make(rows), words, percent, short=short, block=5).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_kept_rows_keep_columns(make):
    docs = make(corpus(5))
    assert jaccard_join.kept_rows(docs).columns == docs.columns
    assert jaccard_join.jaccard_classes(docs.limit(0)).count() == 0


def test_decontaminate(spark, make):
    r = random.Random(9)
    item = [f"b{i}" for i in range(40)]
    changed = [f"z{i}" if i % 7 == 3 else w for i, w in enumerate(item)]
    noise = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    short = "tiny item of six words"
    rows = [(1, " ".join(noise(30) + item + noise(30))), (2, " ".join(noise(5) + changed).upper()), (3, " ".join(noise(200))), (4, None), (5, ""), (6, "so: Tiny, item of six words!"), (7, "tiny item of words"), (None, " ".join(item)), (1, "clean")]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, short), (12, None), (None, "x y z"), (13, "of the"), (10, " ".join(item))], "item_id long, text string")
    got = sorted((str(x.doc_id), x.contaminated, x.item_ids) for x in decontaminate.decontaminate(make(rows), bench).collect())
    want = [("1", True, [10]), ("1", True, [10]), ("2", True, [10]), ("3", False, []), ("4", False, []), ("5", False, []), ("6", True, [11]), ("7", False, []), ("None", True, [10])]
    assert got == want
    assert decontaminate.clean_rows(make(rows), bench).count() == 4
    assert decontaminate.decontaminate(make(rows), bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("length", [11, 12, 13, 14, 15, 16, 19, 20, 24, 25, 29])
def test_masks_hit_every_pattern_of_substitutions(length):
    """All ways of substituting a fifth of the words; a longer stretch falls into parts of 15 and 20 words, one of which keeps the share."""
    gone = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(length), length // 5)])
    hit = np.zeros(len(gone), bool)
    for mask in decontaminate.MASKS:
        for at in range(length - len(mask) + 1):
            hit |= gone & int(mask, 2) << at == 0
    assert hit.all()


def test_decontaminate_finds_short_items_with_substitutions(spark, make):
    item = [f"b{i}" for i in range(13)]
    pairs = list(itertools.combinations(range(13), 2))
    rows = [(i, " ".join(["n1", "n2", *(f"z{j}" if j in c else w for j, w in enumerate(item)), "n3"])) for i, c in enumerate(pairs)]
    bench = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    assert decontaminate.decontaminate(make(rows), bench).where("contaminated").count() == len(pairs)


def test_packing(make):
    rows = corpus(6)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows += [(60, "It's l'Été 12 ﬁn İstanbul don't. naïve\u00a0x\x1cy ẞ <|endoftext|> ***")]
    packed = packing.pack(packing.pieces(make(rows), path, 2, 64), 64, group=30).collect()
    want = {}
    for d, t in rows:
        want.setdefault(str(d), []).append([*plain.encode(t or "", add_special_tokens=False).ids, 2])
    docs = {}
    for p in sorted(packed, key=lambda p: p.start):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 64
        docs.setdefault(str(p.doc_id), []).append((p.start, ids))
    assert {d: sorted(x for _, i in v for x in i) for d, v in docs.items()} == {d: sorted(x for i in v for x in i) for d, v in want.items()}
    single = [d for d, v in want.items() if len(v) == 1]
    assert all([x for _, i in docs[d] for x in i] == want[d][0] for d in single)
    places = {}
    for p in packed:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_first_fit_decreasing():
    r = random.Random(2)
    lengths = sorted((r.randint(1, 50) for _ in range(300)), reverse=True)
    room, want = [], []
    for n in lengths:
        at = next((i for i, x in enumerate(room) if x >= n), len(room))
        if at == len(room):
            room.append(50)
        want.append((at, 50 - room[at]))
        room[at] -= n
    assert list(zip(*packing.first_fit_decreasing(lengths, 50))) == want


def test_token_counts(make):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    entries = set(token_counts.rank_file(path))

    def greedy(s):
        n = 0
        while s:
            k = next(k for k in range(len(s), 0, -1) if s[:k] in entries)
            s, n = s[k:], n + 1
        return n

    rows = corpus(7)
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in token_counts.token_counts(make(rows), path).collect())
    find = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    assert got == sorted((str(d), len(find(t)), sum(greedy(b" " + w) for w in find(t))) for d, t in rows)
    small = token_counts.Automaton([b"a", b"abcd", b"b", b"bc", b"cde"])
    assert [small.count(w) for w in (b"", b"abcd", b"abcb", b"abc", b"x", b"abcx", b"abcdb")] == [0, 1, 3, 2, 1, 1, 2]


def test_context_tree_is_a_distribution(make):
    rows = [(i, t) for i, t in corpus(8) if t]
    tree = lm_scoring.learn_tree(make(rows).select("text"), depth=2, support=8)
    contexts = np.array([0, 65, 97 << 8 | 98, 32 << 8 | 119, 255 << 8 | 255], np.uint64)
    codes = (contexts[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()
    assert np.allclose(np.exp2(tree.log2(codes)).reshape(-1, 256).sum(1), 1, atol=1e-5)


@pytest.mark.parametrize("support", [1, 2, 5])
def test_context_tree_keeps_what_occurs_often_enough(make, support):
    """Against the recursion over a tree held in dicts; most contexts are far below any share of the bytes."""
    depth, rows = 3, corpus(3, 14)
    count = {}
    for _, t in rows:
        line = bytes([255] * depth) + (t or "").translate(LOW).encode() + b"\xff"
        for i in range(depth, len(line)):
            for d in range(depth + 1):
                at = count.setdefault(line[i - d : i], {})
                at[line[i]] = at.get(line[i], 0) + 1
    kept = {c for c, seen in count.items() if not c or sum(seen.values()) >= support}
    below = {c: [bytes([b]) + c for b in range(256) if bytes([b]) + c in kept] for c in kept}

    def split(c, node, k):
        zeros = sum(n for b, n in count[c].items() if (1 << k | b >> 8 - k) == node and not b >> 7 - k & 1)
        return zeros, sum(n for b, n in count[c].items() if (1 << k | b >> 8 - k) == node and b >> 7 - k & 1)

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @functools.cache
    def weigh(c, node, k):
        """(log likelihood with all below, own weight, chance of a one in the leaf of the rest)"""
        zeros, ones = split(c, node, k)
        if len(c) == depth:
            return kt(zeros, ones), 1.0, 0.5
        inner = [(x, split(x, node, k)) for x in below[c]]
        left = zeros - sum(z for _, (z, _) in inner), ones - sum(o for _, (_, o) in inner)
        under = kt(*left) + sum(weigh(x, node, k)[0] for x, n in inner if sum(n))
        both = float(np.logaddexp(kt(zeros, ones), under)) - math.log(2)
        return both, math.exp(kt(zeros, ones) - math.log(2) - both), (left[1] + 0.5) / (sum(left) + 1)

    def chance(c, node, k):
        given, left = 0.0, 1.0
        for d in range(depth + 1):
            here = c[depth - d :]
            if here not in kept:
                break
            zeros, ones = split(here, node, k)
            if not zeros + ones:
                return given + left / 2
            _, own, rest = weigh(here, node, k)
            given, left = given + left * own * (ones + 0.5) / (zeros + ones + 1), left * (1 - own)
        return given + left * rest

    r = random.Random(2)
    asked = [(c, b) for c in r.sample([c for c in count if len(c) == depth], 40) for b in (*count[c], 97)] + [(b"qqq", 97), (b"\xfd w", 120), (b"\xfd\xfe\xfd", 254)]
    code = np.array([int.from_bytes(c, "big") << 8 | b for c, b in asked], np.uint64)
    want = []
    for c, b in asked:
        ones = [chance(c, 1 << k | b >> 8 - k, k) for k in range(8)]
        want.append(sum(math.log2(p if b >> 7 - k & 1 else 1 - p) for k, p in enumerate(ones)))
    assert np.allclose(lm_scoring.learn_tree(make(rows).select("text"), depth, support).log2(code), want, atol=1e-6)


def test_lm_scores(make):
    rows = corpus(8, 80)
    got = lm_scoring.lm_scores(make(rows)).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = [(d, WORD.findall((t or "").translate(LOW)) + [None]) for d, t in rows]
    count = {}
    for d, ws in tokens:
        for w in ws if not held(d) else []:
            count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    want = sorted((str(d), held(d), len(ws), sum(w in count for w in ws), round(float(sum(np.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in ws)), 6)) for d, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert lm_scoring.lm_scores(make(rows).limit(0)).count() == 0


def test_quality_classifier(spark, make):
    r = random.Random(5)
    word = lambda: "".join(r.choices("aeionst", k=5))
    rows, labels = [], []
    for i in range(400):
        good = r.random() < 0.7
        rows.append((i, " ".join(word() + ("" if good else "###") for _ in range(60))))
        if i % 2:
            labels.append((i, int(good), 0))
    truth = {i: "#" not in t for i, t in rows}
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(make([*rows, (None, None)]), marks).collect()
    assert len(got) == 401 and np.mean([g.keep == truth[g.doc_id] for g in got if g.doc_id is not None and g.doc_id % 2 == 0]) > 0.95
    docs = make(rows)
    assert quality_classifier.kept_rows(docs, marks).columns == docs.columns
    assert quality_classifier.quality_scores(docs, marks.limit(0)).where("keep").count() == 400


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://NET", "https://a.net/x?q#f", "http://x.example.net/en/1", "http://example.net/en", "ftp://example.com/de/a#b", "http://anexample.com/de/", "http://b.org/fr/", "http://xorg/fr/", "http://a..net/", "x://u@h:80/p://q"]
    pages = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string").selectExpr("*", "1 as key", "'z' as stack")
    rules = spark.createDataFrame([*queries.RULES], "host string, path string, verdict string")
    got = sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_filter.url_filter(pages, rules, salts=3, ranges=4).collect())

    def judge(i, u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fit = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")

    assert got == sorted([judge(i, u) for i, u in enumerate(urls)] * 2)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if stage is not corpus_pipeline.pack:
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()

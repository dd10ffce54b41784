import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import jaccard, substring, textops
from colonnade.llm.components import connected_components
from colonnade.llm.fmindex import FMIndex, WaveletMatrix

from .conftest import documents, words


# Substrings


def brute_removed(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 9])
def test_repeats_in_corpus(corpus, window):
    got = substring.remove_repeats(corpus, window=window)
    want = brute_removed([(r["doc_id"], r["text"]) for r in corpus.collect()], window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == want


def test_small_filter_and_shards_lose_nothing(corpus, spark):
    rows = corpus.select("doc_id", "text")
    a = substring.repeated_spans(rows)
    b = substring.repeated_spans(rows, shard_bytes=20_000, filter_bytes=64)
    total = lambda df: df.groupBy().sum("windows").first()[0]
    assert total(a) == total(b)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_in_noise(spark, seed):
    r = random.Random(seed)
    passages = [[r.choice("abc") for _ in range(r.randrange(15, 60))] for _ in range(4)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(r.randrange(5)):
            t += r.choice([r.choice(passages), [r.choice("abcdefgh") for _ in range(r.randrange(30))], ["z"] * r.randrange(50)])
        rows.append((i, r.choice([" ", "\n", "  "]).join(t)))
    got = substring.remove_repeats(documents(spark, rows), window=20).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got} == brute_removed(rows, 20)


def one_line_in_all(seed):
    """Documents with one line in common, and some whole passages around it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    line = [word() for _ in range(12)]
    around = [([word() for _ in range(15)], [word() for _ in range(15)]) for _ in range(10)]
    rows = []
    for i in range(600):
        a, b = r.choice(around) if i % 10 == 0 else ([word() for _ in range(15)], [word() for _ in range(15)])
        rows.append((i, " ".join([word(), *a, *line, *b, word()])))
    return rows


def test_a_line_in_every_document_sends_no_unique_window(spark, monkeypatch):
    rows = one_line_in_all(3)
    monkeypatch.setattr(substring, "_SLICE", 4000)  # the driver's closures carry it
    docs = documents(spark, rows).repartition(8)
    got = substring.remove_repeats(docs, window=20).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got} == brute_removed(rows, 20)


def test_parts_of_runs():
    r = np.random.default_rng(1)
    rows = [" ".join(f"w{x}" for x in [*r.integers(0, 9999, 15), *range(20_000, 20_012), *r.integers(0, 9999, 15)]) for _ in range(300)]
    text = " ".join(rows).encode()
    sizes = np.append(0, np.cumsum([len(x) + 1 for x in rows]))
    sizes[-1] -= 1
    head, s, w, h, _ = substring._slice_runs(np.frombuffer(text, np.uint8), sizes, np.arange(300), 20, 8, 7)
    shared = np.bincount(np.unique(head["key"], return_inverse=True)[1]).max()
    assert shared > 100  # the line's key leads in many runs

    def bits(values, hot=(), n=1 << 16):
        def filled(x):
            x = np.asarray(x, np.uint64)
            return {k: np.packbits(np.isin(np.arange(n), substring._places(x[substring._shards(x, 4) == k], n)), bitorder="little").tobytes() for k in range(4)}

        known, often = filled(values), filled(hot)
        return substring.Filter({k: (known[k], often[k] if len(hot) else b"") for k in known}, 4, n)

    keys, n = np.unique(head["key"], return_counts=True)
    none, _ = substring._pieces(head, s, h, w, bits(keys[n > 1]), bits([]), 20)
    assert len(none) == 0
    at = substring._ranges(s, head["windows"].astype(np.int64))
    some = substring._run_hashes(h, at, np.full(len(at), 20))[::3]
    for hot in ((), keys[n > 100]):
        parts, first = substring._pieces(head, s, h, w, bits(keys, hot=hot), bits(some), 20)
        assert len(parts) and (parts["bytes"] == w.end[first + parts["windows"] + 18] - w.start[first]).all()
        covered = set(substring._run_hashes(h, t := substring._ranges(first, parts["windows"].astype(np.int64)), np.full(len(t), 20)).tolist())
        assert covered >= set(some.tolist())
        if len(hot):
            single = ~np.isin(parts["key"], keys)
            assert single.any() and (parts["windows"][single] == 1).all()


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


LONG_WORDS = [1024, 2048, 4096, 65_536]


def test_long_words_that_differ_everywhere_are_no_repeats(spark):
    rows = []
    for n in LONG_WORDS:
        rows += [(len(rows), " ".join([thue_morse(n)] * 10 + [f"{n}x{i}" for i in range(10)])), (len(rows) + 1, " ".join([thue_morse(n, "b", "a")] * 10 + [f"{n}x{i}" for i in range(10)]))]
    got = substring.remove_repeats(documents(spark, rows), window=20).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got} == brute_removed(rows, 20)
    assert not any(x["n_removed"] for x in got)


def test_long_words_that_differ_everywhere_dont_link(spark):
    rows = [(2 * k + i, f"{thue_morse(n, *pair)} {thue_morse(n, *pair)}") for k, n in enumerate(LONG_WORDS) for i, pair in enumerate(("ab", "ba"))]
    assert components(documents(spark, rows)) == brute_components(rows, 4, 85, 100)


def test_word_hashes_are_of_all_bytes():
    words_ = [b"a" * n for n in (1, 7, 8, 9, 15, 16, 17, 255, 256, 257, 600)]
    words_ += [w[:-1] + b"b" for w in words_] + [b"b" + w[1:] for w in words_[1:]] + [w[: len(w) // 2] + b"c" + w[len(w) // 2 + 1 :] for w in words_ if len(w) > 2]
    words_ = sorted(set(words_))
    text = b" ".join(words_)
    w = textops.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(set(w.hashes(5).tolist())) == len(words_) and not set(w.hashes(5).tolist()) & set(w.hashes(6).tolist())
    assert [h for x in words_ for h in textops.Words(np.frombuffer(x, np.uint8), np.array([0, len(x)])).hashes(5).tolist()] == w.hashes(5).tolist()


def test_cut_documents_keep_their_columns(edge):
    got = {r["doc_id"]: r for r in substring.remove_repeats_from(edge).collect()}
    assert 7 in got and 8 not in got and got[9]["text"].endswith("tail") and got[0]["text"] is None
    assert got[9]["n_chars"] == len(got[9]["text"]) and got[1]["n_chars"] == 0
    assert set(got[7].asDict()) == set(edge.columns)


def test_no_documents(none):
    assert substring.remove_repeats(none).count() == 0


def test_repeated_ids(spark):
    rows = substring.remove_repeats(documents(spark, [(1, "b"), (1, "a c"), (None, "z"), (2, None)])).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in rows) == [(1, 2), (2, 0)]


@given(st.lists(st.integers(0, 9), max_size=300), st.integers(1, 10))
@settings(max_examples=60, deadline=None)
def test_wavelet_ranks(values, kinds):
    x = np.array(values, np.int64) % kinds
    m = WaveletMatrix(x, kinds)
    for c in range(kinds):
        i = np.arange(len(x) + 1)
        assert m.rank(np.full(len(i), c), i).tolist() == [int((x[:k] == c).sum()) for k in i]


@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=40), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=30), min_size=1, max_size=4), st.integers(2, 20))
@settings(max_examples=60, deadline=None)
def test_matching_statistics(parts, queries, depth):
    text = np.array([x for p in parts for x in [*p, 0]], np.int64)
    index = FMIndex(text, depth)
    lengths = np.array([len(q) for q in queries])
    flat = np.array([x for q in queries for x in q], np.int64)
    got, lo = index.matching_statistics(flat, np.cumsum(lengths) - lengths, lengths)
    t, k = text.tolist(), 0
    for q in queries:
        for i in range(len(q)):
            best = max((n for n in range(1, min(depth, len(q) - i) + 1) if any(t[a : a + n] == q[i : i + n] for a in range(len(t)))), default=0)
            assert got[k] == best
            if best:  # the interval holds every place of the match
                low, high = index.bounds(best, lo[k : k + 1])
                assert low[0] == lo[k] and high[0] - low[0] == sum(t[a : a + best] == q[i : i + best] for a in range(len(t)))
            k += 1


# Jaccard


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            c = len(x & y)
            if c and den * c >= num * (len(x) + len(y) - c):
                p, q = find(ids[a]), find(ids[b])
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def components(df, *a, **k):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, *a, **k).collect()}


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_components_in_corpus(corpus, n, num, den):
    assert components(corpus, n, num, den) == brute_components([(r["doc_id"], r["text"]) for r in corpus.collect()], n, num, den)


def near_copies(seed, groups=12, copies=14):
    """Chains of edits, so that some copies are linked only through others."""
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [r.choice("abcdefghijklmnop") + str(r.randrange(40)) for _ in range(r.randrange(4, 160))]
        for _ in range(copies):
            if r.random() < 0.5:
                base = list(base)
                for _ in range(r.randrange(1, 1 + len(base) // 20 + 1)):
                    base[r.randrange(len(base))] = "new" + str(r.randrange(1000))
            rows.append((len(rows), " ".join(base if r.random() < 0.8 else base + ["tail"] * r.randrange(8))))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (3, 80, 100)])
def test_chains(spark, seed, n, num, den):
    rows = near_copies(seed)
    df = documents(spark, rows)
    want = brute_components(rows, n, num, den)
    assert components(df, n, num, den) == want
    if seed == 0:  # regions that don't fit a task are cut, and joined block by block where they can't be
        assert components(df, n, num, den, region_members=300) == want


@pytest.mark.parametrize("seed", range(4))
def test_region_by_pivots(seed, monkeypatch):
    monkeypatch.setattr(jaccard.Region, "LEAF", 10)
    monkeypatch.setattr(jaccard.Region, "PIVOTS", 4)
    r = np.random.default_rng(seed)
    sets = []
    for g in range(12):
        core = r.choice(1000, 60, replace=False).astype(np.uint64)
        for _ in range(12):
            s = core.copy()
            s[r.choice(60, r.integers(0, 9), replace=False)] = r.integers(2000, 1 << 40, 1)[0]
            sets.append(np.unique(s))
    like = jaccard.Likeness(85, 100)
    got = jaccard.Region(sets, like).run()
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    assert got.tolist() == up


@pytest.mark.parametrize("seed", range(2))
def test_regions_on_the_cluster_hold_every_link(spark, seed):
    r = random.Random(seed)
    texts = []
    for g in range(16):
        core = [f"g{g}w{i}" for i in range(r.choice([40, 40, 60]))]
        for _ in range(20):
            texts.append(" ".join(core[r.randrange(4) :] + [f"x{r.randrange(10**9)}" for _ in range(r.randrange(5))]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    like, sets = jaccard.Likeness(85, 100), [set(t.split()) for t in texts]
    members = spark.createDataFrame([(7, i, len(s)) for i, s in enumerate(sets)], "region long, rep long, n long")
    got = jaccard._by_regions(rows, members, 1, textops.fresh_key(), like, 2000).collect()
    held, inner = {}, {}
    for x in got:
        held.setdefault(x["region"], set()).add(x["rep"])
        if x["inner"]:
            assert inner.setdefault(x["rep"], x["region"]) == x["region"]
    assert len(inner) == len(texts)  # each is an inner set once
    linked = 0
    for a in range(len(texts)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                linked += 1
                assert b in held[inner[a]] or a in held[inner[b]]
    compared = sum(len(held[inner[a]]) for a in range(len(texts)))
    assert linked > 500 and compared < len(texts) ** 2 / 3 and len(got) < 3 * len(texts)


@pytest.mark.parametrize(("n", "num"), [(1, 80), (2, 50)])
def test_sets_that_pivots_cannot_part_stay_whole(spark, n, num):
    r = random.Random(num)
    rows = [(i, " ".join(r.sample([f"w{k}" for k in range(400)], 12)) if i % 3 else "one two three four five six") for i in range(90)]
    rows += [(100 + i, " ".join(f"a{k} b{k}" for k in range(i % 5 + 20))) for i in range(60)]
    df = documents(spark, rows)
    assert components(df, n, num, 100, region_members=100) == brute_components(rows, n, num, 100)


def test_small_table_loses_no_pair(spark):
    rows = near_copies(7, groups=6)
    df = documents(spark, rows).select("doc_id", "text")
    like = jaccard.Likeness(85, 100)
    found = {(r["a"], r["b"]) for r in jaccard.candidates(df, 4, 5, like, table_bytes=64).collect()}
    assert found >= {(r["a"], r["b"]) for r in jaccard.candidates(df, 4, 5, like).collect()}


def test_no_rows(none):
    assert components(none) == {}


def test_edges_of_components(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 450: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0

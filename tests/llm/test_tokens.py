import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colonnade.llm import packing, tokenfile
from colonnade.llm.packing import sum_of_squares
from colonnade.llm.shared import scratch
from colonnade.llm.tokens import WordCache

from .conftest import EDGE, documents

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


CACHES = {BYTE: (WordCache(BYTE, True, False, most=50), plain(BYTE)), WORD: (WordCache(WORD, False, True, most=50), plain(WORD))}
alphabet = st.sampled_from(list("abcXYZ ,.!'0é ß\n\t") + ["  ", "\u00a0", "\u2003", "\x1c", "İ", "Σ", "ñ", "😀", "e\u0301", "<|endoftext|>", "'s", "\x01", "word", "the "])


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=st.lists(alphabet, max_size=30).map("".join))
def test_cached_ids_are_the_librarys(path, text):
    cache, ids = CACHES[path]
    assert np.frombuffer(cache.ids(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_corpus_ids(path, corpus):
    cache, ids = CACHES[path]
    for r in corpus.collect():
        assert np.frombuffer(cache.ids(r["text"] or ""), "<u4").tolist() == ids(r["text"])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_round_trip(spark, corpus):
    path = scratch(spark, "test")
    tokenfile.write_tokens(corpus, path, BYTE, end_id=2)
    files = tokenfile.read_tokens(spark, path)
    ids = plain(BYTE)
    want, start = {}, 0
    for r in sorted(corpus.collect(), key=lambda r: r["doc_id"]):
        got = [*ids(r["text"]), 2]
        want[r["doc_id"]] = (start, len(got), crc(got), got)
        start += len(got)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.digest(files).collect()} == {k: v[:3] for k, v in want.items()}
    assert {r["doc_id"]: r["tokens"] for r in files.collect()} == {k: v[3] for k, v in want.items()}
    # within a file ids ascend
    for part in {r["part"] for r in files.select("part").distinct().collect()}:
        own = [r["doc_id"] for r in files.where(f"part = {part}").orderBy("start_in_part").collect()]
        assert own == sorted(own)


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_marks_after_a_word_are_a_piece_of_their_own(path, spaced):
    """Such words don't take the library's long way, and have its ids."""
    cache, long_way = WordCache(path, spaced, lower=not spaced), []
    encode = cache.inner.encode
    cache.inner.encode = lambda text: long_way.append(text) or encode(text)
    text = "a Word%%% é;!? one. two.$$$ and: more***, C# x&"
    want = plain(path)(text)
    assert cache.ids(text) == np.array(want, "<u4").tobytes()
    assert not any(c.isalpha() for x in long_way for c in x)
    for word in ("don't!", "it's;", "a_b_;", "'s#", "x'$", "9;:", "_.", "é\u0301;", "<|endoftext|>;"):
        assert cache.ids("q " + word) == np.array(plain(path)("q " + word), "<u4").tobytes(), word


def test_files_have_indexes_and_bloom_filters(spark, corpus):
    from pyarrow import orc

    path = scratch(spark, "test")
    tokenfile.write_tokens(corpus, path, BYTE, end_id=2)
    found = [f for f in __import__("pathlib").Path(path).rglob("*.orc")]
    assert found and all(orc.ORCFile(f).row_index_stride == 10_000 for f in found)
    plan = tokenfile.read_tokens(spark, path).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def rows_scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_search_reads_what_may_hold_the_document(spark):
    path = scratch(spark, "test")
    docs = spark.range(0, 120_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    tokenfile.write_tokens(docs.coalesce(1), path, BYTE, end_id=2)
    files = tokenfile.read_tokens(spark, path)
    there = files.where("doc_id = 60000").select("doc_id")
    assert there.count() == 1 and 0 < rows_scanned(there) <= 10_000  # a row group of the index
    # odd ids lie within the bounds of every index: only the Bloom filters can tell
    missing = [files.where(f"doc_id = {i}").select("doc_id") for i in (30_001, 50_001, 70_001, 90_001)]
    assert sum(rows_scanned(m) for m in missing) <= 10_000
    outside = files.where("doc_id = 10000000").select("doc_id")
    assert rows_scanned(outside) == 0


def test_a_hot_id_is_split(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    path = scratch(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if they were large
    tokenfile.write_tokens(docs.repartition(8), path, BYTE, end_id=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = tokenfile.read_tokens(spark, path)
    assert files.where("doc_id = 7").select("part").distinct().count() > 2
    got = tokenfile.digest(files).orderBy("start", "n_tokens").collect()
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_repeated_and_null_ids(spark):
    df = documents(spark, [(1, "b"), (1, "a"), (None, "z"), (1, "a")])
    path = scratch(spark, "test")
    tokenfile.write_tokens(df, path, BYTE, end_id=2)
    got = [(r["doc_id"], r["n_tokens"]) for r in tokenfile.digest(tokenfile.read_tokens(spark, path)).orderBy("start").collect()]
    assert got == [(None, 2), (1, 2), (1, 2), (1, 2)]


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("shard_items", [16_384, 40])
def test_packing(corpus, shard_items):
    rows = packing.pack_documents(corpus, WORD, size=512, shard_items=shard_items).collect()
    ids, want = plain(WORD), set()
    for r in corpus.collect():
        got = [*ids(r["text"]), 1]
        want |= {(r["doc_id"], p, a, len(got[a : a + 512]), crc(got[a : a + 512])) for p, a in enumerate(range(0, len(got), 512))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 512) <= 1.05 * -(-total // 512) + 2


def test_packing_of_nothing_and_repeats(spark, none):
    assert packing.pack_documents(none, WORD).count() == 0
    rows = packing.pack_documents(documents(spark, [(1, "x y"), (1, "x y"), (None, None)]), WORD).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", 3), ("1", 3), ("None", 1)]
    assert check_packing(rows, 4096) == 1


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=100, deadline=None)
def test_sum_of_squares_rule(lengths):
    """Each item goes where the brute-force sum of squares becomes smallest."""
    size = 40
    bins, offsets = sum_of_squares(np.array(lengths, np.int64), size)
    fill = {}
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        assert fill.get(b, 0) == o and o + s <= size

        def squares(target, s=s):
            after = dict(fill)
            after[target] = after.get(target, 0) + s
            gaps = [size - v for v in after.values() if 0 < size - v < size]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = {size - v: k for k, v in fill.items() if size - v >= s}
        best = min([squares(k) for k in options.values()] + [squares("new")])
        assert squares(b if b in fill else "new") == best
        fill[b] = o + s


def test_edge_rows_are_all_there(edge):
    assert {r["doc_id"] for r in packing.pack_documents(edge, WORD).collect()} == {i for i, _ in EDGE}

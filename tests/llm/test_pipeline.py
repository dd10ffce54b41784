import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from .conftest import EDGE, documents, words
from .test_dedup import brute_components, brute_removed
from .test_tokens import check_packing


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark, corpus, sf_dir):
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mix_sources", "packing"]
    docs = corpus
    kept = stage["language_id"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    gone = {i for i, _ in rows(docs)} - {i for i, _ in rows(kept)}
    assert {i + 1_000_000 for i in (0, 1, 2, 13)} <= gone and all(i >= 1_000_000 for i in gone)

    docs = kept.cache()
    kept = stage["near_duplicates"](spark, docs, sf_dir)
    want = brute_components(rows(docs), 5, 80, 100)
    assert sorted(i for i, _ in rows(kept)) == sorted(i for i, (_, c) in want.items() if i == c)

    docs = kept.cache()
    kept = stage["substring_dedup"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    removed = brute_removed(rows(docs), 20)
    assert {i: len(words(t)) for i, t in rows(kept)} == {i: n - r for i, (n, r, _) in removed.items() if not r or r < n}

    docs = kept.cache()
    mixed = stage["mix_sources"](spark, docs, sf_dir).cache()
    assert mixed.columns == docs.columns and {i for i, _ in rows(mixed)} <= {i for i, _ in rows(docs)}

    packed = stage["packing"](spark, mixed, sf_dir).collect()
    check_packing(packed, 4096)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    assert sum(r["length"] for r in packed) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in rows(mixed))


def test_null_and_shared_ids_stay(spark, sf_dir):
    passage = " ".join(f"p{i}" for i in range(60))
    own = " ".join(f"q{i}" for i in range(40))
    plain = [(1, passage), (2, passage), (3, "alpha beta gamma"), (3, "delta epsilon"), (None, passage), (None, "zeta eta"), (4, f"{passage} more words"), (5, f"{own} {passage} y {passage} z")]
    docs = documents(spark, plain)
    stage = dict(corpus_pipeline.STAGES)
    assert sorted(rows(stage["language_id"](spark, docs, sf_dir)), key=str) == sorted(plain, key=str)
    first = rows(stage["near_duplicates"](spark, docs, sf_dir))
    assert sorted(first, key=str) == sorted([r for r in plain if r[0] != 2 and r[0] != 4], key=str)
    second = rows(stage["substring_dedup"](spark, documents(spark, first), sf_dir))
    assert sorted(second, key=str) == sorted([*[r for r in first if r[0] != 5], (5, f"{own} y z")], key=str)
    mixed = rows(stage["mix_sources"](spark, documents(spark, second), sf_dir))
    assert {r for r in mixed} and all(any(m[0] == s[0] and set(words(m[1])) <= set(words(s[1])) for s in second) for m in mixed)


def test_run_leaves_its_result_only(spark, sf_dir, tmp_path, monkeypatch):
    from colonnade import storage

    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    packed = corpus_pipeline.run(spark, sf_dir)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.glob("colonnade/*/*")] == ["stage-packing"] and packed.count() > 0


def test_edges_run_through(spark, sf_dir):
    docs = documents(spark, EDGE + [(None, "null id text"), (3, "again one")])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    assert docs.count() > 0
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    assert docs.count() == 0

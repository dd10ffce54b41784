"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them.

Each query reads its whole table, applies one operator with production parameters
and keeps the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_render, jaccard, langid, mixing, mtree, packing, rpforest, substring, tokenfile, urlfilter
from .shared import bounded_batches, scratch


#: The rules that op9 applies.
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mix).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = langid.learn(docs.where(~held_out).select("text", "lang"))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), size=4096, end_id=1)


def op5_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree.top_k(vectors, vectors.where("id % 50 = 0"), k=5)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.link_near(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", limit=0.95)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urlfilter.parse(r) for r in URL_RULES]
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenfile.digest(tokenfile.read_tokens(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_language_id": op3_language_id,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_mtree_top_k": op5_mtree_top_k,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_html_text": op7_html_text,
        "op8_near_vectors": op8_near_vectors,
        "op9_url_filter": op9_url_filter,
        "op10_token_files": op10_token_files,
    }


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: A window's words are joined by a space, which no word holds, so equal strings are equal windows.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS start, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, start, md5(array_to_string(w[start + 1 : start + 20], ' ')) AS h FROM s),
r AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS n FROM k) WHERE n > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(start, start + 20)))) AS gone FROM r GROUP BY doc_id),
x AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
c AS (SELECT doc_id, unnest(gone) AS i FROM g),
t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 5
"""

OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(reach) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id
"""

#: Every pair is compared here, while the forest's recall is high but not promised to be whole.
OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.n * b.n) >= 0.95),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
m AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, component_id = m.vec_id AS kept FROM m
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: not those with tokenizers, trained models, random draws or rendering."""
    return {"op2_substring_dedup": OP2_SQL, "op5_mtree_top_k": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op8_near_vectors": OP8_SQL}

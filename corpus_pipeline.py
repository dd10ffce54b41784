"""The corpus pipeline: documents to packed training sequences.

Counted as part of the subpackage ``colonnade.llm``.  Each stage takes
(spark, docs, sf_dir), works on every row that its predecessor kept, and returns a
DataFrame, which :func:`run` writes as Parquet and reads again for the next stage.  All
stages but the last return the columns of ``documents``.

* ``language_id`` learns profiles from the labelled rows and drops documents without a letter and
  long ones unlike every language; others get their predicted language.
* ``near_duplicates`` keeps the document with the smallest id of each component of the
  Jaccard join of five-word shingles at 0.8.
* ``substring_dedup`` removes words covered by 20-word windows that start earlier; a
  document of which nothing is left goes.
* ``mix_sources`` takes each source's words to its target, cutting and repeating documents.
* ``packing`` packs the documents' tokens into sequences of 4096.

Every stage gives no rows for an empty table, and other columns than those named in its
docstring pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import jaccard, langid, mixing, packing, substring
from colonnade.llm.queries import vocabulary
from colonnade.llm.shared import bounded_batches, discard, intermediates, keep, written

#: A text of ``LONG`` characters has a cosine of 0.1 or more with its own language; chance alone has a
#: spread of 0.03, and may put a clean text of a few words at any value, so these aren't judged.
MIN_COSINE, LONG = 0.05, 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` whose text has a letter and, from ``LONG`` characters on, a cosine of ``MIN_COSINE`` with
    some language; ``lang`` is what is predicted.

    A null or empty text goes.  Rows are judged one by one: null or shared ids and repeated rows
    make no difference; rows with a null text or lang teach nothing.
    """
    bounded_batches(spark)
    profiles = langid.learn(docs.select("text", "lang"))
    judged = langid.identify(docs, profiles)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & ((F.col("score") >= MIN_COSINE) | (F.length("text") < LONG)))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that aren't the smallest ``doc_id`` of their component.

    Texts that are null or have no words are like no other and stay.  Rows with a null ``doc_id``
    stay, as nothing can name them; rows that share one stay or go as the first of them does.
    """
    bounded_batches(spark)
    found = jaccard.jaccard_components(docs, words=5, num=80, den=100)
    copies = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(copies.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (and ``n_chars`` its length).

    Texts that are null or shorter than a window stay as they are, and so do rows whose ``doc_id``
    is null or shared, which the order that tells first occurrences from later ones doesn't hold.
    """
    bounded_batches(spark)
    return substring.remove_repeats_from(docs, window=20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: one row for each document and epoch it is in.

    A text without words is never taken.  A null ``source`` is a source; rows with null or
    shared ids and repeated rows are documents of their own.
    """
    bounded_batches(spark)
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a null ``doc_id`` stays null; repeated rows are packed
    as often as they stand.
    """
    bounded_batches(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows.  What a stage wrote goes
    once the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with intermediates(spark) as made:
            out = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"), made)
        discard(docs)  # the stage before; the input isn't this run's
        docs = out
    return docs

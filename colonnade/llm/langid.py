"""Operator 3: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram of letters (with a mark at
either end of a word) is bound to the vector x_a shifted by two places, times x_b
shifted by one, times x_c; a text's vector is the sum over its trigrams, a language's
prototype the sum over its labelled texts.  A text gets the language whose prototype
has the largest cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import lean

UNDETERMINED = "und"
_BITS = 11
LETTERS = 1 << _BITS  # the end mark 0, a to z, and one of 2021 classes by hash for any other letter
_CHUNK = 4096
_tables: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Letter class of every code point, upper case as lower; 0 for what isn't a letter."""
    if "letters" not in _tables:
        lower = np.zeros(0x110000, np.uint64)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                lower[cp] = ord(low) if len(low) == 1 else cp
        other = 27 + (textops.mix(lower) % np.uint64(LETTERS - 27)).astype(np.int64)
        _tables["letters"] = np.where(lower == 0, 0, np.where((lower >= 97) & (lower <= 122), lower.astype(np.int64) - 96, other)).astype(np.uint16)
    return _tables["letters"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every trigram of the texts; a code's middle is a letter."""
    texts = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
    cps = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = letter_table()[cps]
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])  # of places 1 and on
    mid = np.flatnonzero(ids[1:-1]) + 1
    ids = ids.astype(np.int64)
    codes = (ids[mid - 1] << (2 * _BITS)) | (ids[mid] << _BITS) | ids[mid + 1]
    return rows[mid - 1], codes


@dataclass(frozen=True)
class Profiles:
    """Prototypes of unit length, one row per language of ``langs``."""

    langs: tuple[str, ...]
    vectors: np.ndarray
    seed: int

    @property
    def dims(self) -> int:
        return self.vectors.shape[1]


def letter_vectors(dims: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.random.default_rng(seed).integers(0, 2, (LETTERS, dims)).astype(np.float32) * 2 - 1
    return np.roll(x, 2, axis=1), np.roll(x, 1, axis=1), x


def bundle(counts: np.ndarray, codes: np.ndarray, letters: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows of ``counts`` (row x code) times the codes' vectors, a chunk of codes at a time."""
    mask = LETTERS - 1
    out = np.zeros((len(counts), letters[0].shape[1]), counts.dtype)
    for i in range(0, len(codes), _CHUNK):
        c = codes[i : i + _CHUNK]
        v = letters[0][c >> (2 * _BITS)]
        v *= letters[1][(c >> _BITS) & mask]
        v *= letters[2][c & mask]
        out += counts[:, i : i + _CHUNK] @ v
    return out


def _added(codes: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the sums of their counts."""
    every, at = np.unique(np.concatenate([codes, more]), return_inverse=True)
    return every, np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)


def learn(labelled: DataFrame, dims: int = 1024, seed: int = 5) -> Profiles:
    """Prototypes from every row of ``labelled`` (``text``, ``lang``) with text and lang.

    Bundling is a sum, so each task bundles what it has of a language, and these vectors of whole
    numbers are summed; ``dims`` numbers for each language reach the driver.  An empty table
    gives no profiles.
    """
    most = 1 << 20  # distinct trigrams of a task's languages before they are bundled

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(dims, seed)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in sums.items():
                total = np.zeros(dims, np.int64)
                for i in range(0, len(codes), _CHUNK):  # whole numbers as doubles are exact
                    total += np.rint(bundle(n[None, i : i + _CHUNK].astype(np.float64), codes[i : i + _CHUNK], letters)[0]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dims, pa.string()), pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)], names=["lang", "dim", "n"])
            sums.clear()

        none = np.zeros(0, np.int64)
        for b in batches:
            _, offs = textops.text_buffer(b.column(0))
            for i, j in textops.slices(offs):
                texts, langs = b.column(0).slice(i, j - i).to_pylist(), np.array(b.column(1).slice(i, j - i).to_pylist(), object)
                row, code = trigrams(texts)
                for lang in sorted(set(langs.tolist())):
                    got, n = np.unique(code[(langs == lang)[row]], return_counts=True)
                    sums[lang] = _added(*sums.get(lang, (none, none)), got, n)
                if sum(len(c) for c, _ in sums.values()) > most:
                    yield from rows()
        yield from rows()

    sent = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, dim int, n bigint")
    rows = sent.groupBy("lang", "dim").agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values(["lang", "dim"])
    langs = tuple(sorted(rows["lang"].unique()))
    vectors = rows["n"].to_numpy(np.float64).reshape(len(langs), dims)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Profiles(langs, vectors.astype(np.float32), seed)


def cosines(texts: list[str], profiles: Profiles, letters: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cosine of each text with each prototype, whether it has a letter)."""
    row, code = trigrams(texts)
    distinct, at = np.unique(code, return_inverse=True)
    n = len(texts)
    has = np.bincount(row, minlength=n) > 0
    out = np.zeros((n, len(profiles.langs)), np.float32)
    for i in range(0, n, 512):
        j = min(n, i + 512)
        a, z = np.searchsorted(row, [i, j])
        if a == z:
            continue
        used, own = np.unique(at[a:z], return_inverse=True)
        counts = np.bincount((row[a:z] - i).astype(np.int64) * len(used) + own, minlength=(j - i) * len(used)).reshape(j - i, len(used)).astype(np.float32)
        h = bundle(counts, distinct[used].astype(np.int64), letters)
        norm = np.linalg.norm(h, axis=1, keepdims=True)
        out[i:j] = (h @ profiles.vectors.T) / np.maximum(norm, 1e-12)
    return out, has


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the cosine, cut to 0..1) to every row of ``docs`` (``text``).

    A null text, one without a letter, or an empty set of profiles gives ``und`` and 0; an empty
    table gives no rows.
    Only the text is looked at; ties go to the first language in code point order.  All
    columns of ``docs`` stay but ``lang_pred`` and ``score``, which are replaced.
    """
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = cols.index("text")
    schema = T.StructType([*docs.select(*cols).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x dims numbers

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        letters = letter_vectors(p.dims, p.seed)
        for b in batches:
            _, offs = textops.text_buffer(b.column(at))
            for i, j in textops.slices(offs, 1 << 20):
                part = b.slice(i, j - i)
                lang, score = [UNDETERMINED] * (j - i), np.zeros(j - i)
                if p.langs:
                    cos, has = cosines([t or "" for t in part.column(at).to_pylist()], p, letters)
                    best = cos.argmax(axis=1)
                    lang = [p.langs[k] if h else UNDETERMINED for k, h in zip(best.tolist(), has.tolist())]
                    score = np.where(has, np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=schema.fieldNames())

    return docs.select(*cols).mapInArrow(run, schema)

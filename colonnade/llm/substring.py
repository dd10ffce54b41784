"""Operator 2: removing repeated passages with an FM-index per shard.

Windows of ``window`` words are dealt to shards by content: a window's key is the smallest
hash among the ``gram``-word sequences it holds, so equal windows share a shard, and
neighbouring windows with one key travel together as a run of words.  Two filters tell
what may be repeated, first of keys, then of whole windows; only such windows travel.  A key
that very many runs have - of a line in every document - would fill one shard, so its
windows are dealt one by one, by their own hashes.

In a shard equal runs are one, the earliest.  Runs are indexed, and streamed through backward
search over the shard's wavelet matrix: where the matching statistic reaches the window length,
the first place that was streamed through an interval is where its window starts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .fmindex import FMIndex
from .shared import input_bytes, lean, one_row_per_id, tidy, unique_ids, written

U64 = np.uint64
_SLICE = 1 << 20  # bytes of text at a time
_RUN = 32  # windows of a run at most, so that runs are streamed in few steps
_HOT = 64  # times that a key is sent and more, so that its windows are dealt one by one
_HEAD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("bytes", "<i4"), ("twice", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("windows", "<i4")])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    more = width - have
    return np.minimum(x[:-more], x[more:]) if more else x


def _run_hashes(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of words start..start+length-1 for each run."""
    up, down = textops._powers_to(len(words) + 1)
    total = np.append(U64(0), np.cumsum(textops.mix(words) * up[: len(words)]))
    return textops.mix((total[start + length] - total[start]) * down[start] + length.astype(U64) * U64(0xA0761D6478BD642F))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes start[i]..start[i]+length[i]-1 of all i, one after the other."""
    ends = np.cumsum(length)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        out[0] = start[0]
        out[ends[:-1]] = start[1:] - start[:-1] - length[:-1] + 1
        np.cumsum(out, out=out)
    return out


def _firsts(key: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind."""
    _, first = np.unique(key, return_index=True)
    out = np.zeros(len(key), bool)
    out[first] = True
    return out


def runs_of(data: np.ndarray, offs: np.ndarray, docs: np.ndarray, window: int, gram: int, salt: int) -> tuple[np.ndarray, np.ndarray, textops.Words, np.ndarray]:
    """(run heads, first word of each, words, their hashes) of the texts; a head's ``bytes`` are of its words."""
    w = textops.Words(data, offs)
    h = w.hashes(salt)
    counts = w.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = textops.gram_hashes(h, gram)
    keys = _sliding_min(grams, window - gram + 1) if len(h) >= window else np.zeros(0, U64)
    t = np.arange(len(keys))
    t = t[doc[t] == doc[t + window - 1]]  # windows within one text
    if not len(t):
        return np.zeros(0, _HEAD), np.zeros(0, np.int64), w, h
    new = np.append(True, (t[1:] != t[:-1] + 1) | (keys[t[1:]] != keys[t[:-1]]) | (doc[t[1:]] != doc[t[:-1]]))
    since = np.arange(len(t)) - np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    new |= since % _RUN == 0
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(t)))
    s = t[first]
    head = np.zeros(len(s), _HEAD)
    head["key"], head["doc"], head["start"], head["windows"] = keys[s], docs[doc[s]], s - w.first[doc[s]], n
    head["bytes"] = w.end[s + n + window - 2] - w.start[s]
    # only a run that holds its key twice can repeat itself
    reach = n + window - gram
    head["twice"] = np.add.reduceat(grams[_ranges(s, reach)] == np.repeat(head["key"], reach), np.cumsum(reach) - reach) > 1
    order = np.lexsort((head["start"], head["doc"]))
    return head[order], s[order], w, h


def _word_hashes(text: bytes, sizes: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the words of runs that a byte ends, a slice of runs at a time."""
    data, offs = np.frombuffer(text, np.uint8), np.append(0, np.cumsum(sizes.astype(np.int64) + 1))
    parts = [textops.Words(data[offs[i] : offs[j]], np.array([0, offs[j] - offs[i]])).hashes(salt) for i, j in textops.slices(offs, _SLICE)]
    return np.concatenate([*parts, np.zeros(0, U64)])


def earlier_windows(head: np.ndarray, text: bytes, window: int, salt: int) -> np.ndarray:
    """Spans of windows that start earlier among the runs; ``head`` in (doc, start) order."""
    length = head["windows"].astype(np.int64) + window - 1
    start = np.cumsum(length) - length
    h = _word_hashes(text, head["bytes"], salt)
    _, first, kind, copies = np.unique(_run_hashes(h, start, length), return_index=True, return_inverse=True, return_counts=True)
    _, at, many = np.unique(head["key"][first], return_inverse=True, return_counts=True)
    use = (many[at] > 1) | (head["twice"][first] > 0) | (copies > 1)  # of kinds of runs; other ones hold nothing repeated
    if not use.any():
        return np.zeros(0, _SPAN)
    runs = np.sort(first[use])
    of_kind = np.full(len(use), -1)
    of_kind[kind[runs]] = np.arange(len(runs))
    own, start, length = head[runs], start[runs], length[runs]
    symbols = np.unique(h[_ranges(start, length)], return_inverse=True)[1].astype(np.int64) + 1
    del h
    place = np.cumsum(length + 1) - length - 1
    whole = np.zeros(int((length + 1).sum()), np.int64)
    whole[_ranges(place, length)] = symbols
    matched, lo = FMIndex(whole, window).matching_statistics(whole, place, length)
    at = np.flatnonzero((matched == window) & (whole > 0))  # where windows start
    # runs are streamed in order, so an interval's window starts first at its first place
    hit = at[~_firsts(lo[at])]
    out = []
    if len(hit):
        run = np.searchsorted(place, hit, "right") - 1
        cut = np.append(True, (hit[1:] != hit[:-1] + 1) | (run[1:] != run[:-1]))
        a = np.flatnonzero(cut)
        span = np.zeros(len(a), _SPAN)
        span["doc"], span["start"] = own["doc"][run[a]], own["start"][run[a]] + hit[a] - place[run[a]]
        span["windows"] = np.diff(np.append(a, len(hit)))
        out.append(span)
    # a copy has the windows of the run it equals, which the index found at an earlier place
    found = np.bincount(np.searchsorted(place, at, "right") - 1, minlength=len(runs)) == own["windows"]
    copy = np.ones(len(head), bool)
    copy[first] = False
    copy &= (of_kind[kind] >= 0) & found[of_kind[kind]]
    return np.concatenate([*out, _spans(head[copy])])


def _spans(head: np.ndarray) -> np.ndarray:
    out = np.zeros(len(head), _SPAN)
    for name in _SPAN.names:
        out[name] = head[name]
    return out


def _slice_runs(data: np.ndarray, offs: np.ndarray, docs: np.ndarray, window: int, gram: int, salt: int) -> tuple[np.ndarray, np.ndarray, textops.Words, np.ndarray, np.ndarray]:
    """(heads, first words, words, their hashes, spans): a slice's runs, equal ones once (the
    earliest); the spans are of the others, whose windows all start earlier."""
    head, s, w, h = runs_of(data, offs, docs, window, gram, salt)
    if not len(head):
        return head, s, w, h, np.zeros(0, _SPAN)
    first = _firsts(_run_hashes(h, s, head["windows"].astype(np.int64) + window - 1))
    return head[first], s[first], w, h, _spans(head[~first])


class Sent:
    """What a task has sent, as far as a table of fixed size remembers, so that hashes which are
    frequent don't travel from each of its slices."""

    def __init__(self, size: int = 1 << 16):
        self.mask = U64(size - 1)
        self.hash, self.times = np.zeros(size, U64), np.zeros(size, np.int8)
        self.doc, self.start = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def twice(self, values: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which of the distinct ``values`` were sent twice already; the others, found ``n`` times, are sent now."""
        slot = textops.mix(values) & self.mask
        same = self.hash[slot] == values
        before = np.where(same, self.times[slot], 0)
        self.hash[slot], self.times[slot] = values, np.minimum(before + np.minimum(n, 2), 2)
        return before >= 2

    def earlier(self, values: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of the distinct ``values`` were sent from an earlier place; the others are sent now."""
        slot = textops.mix(values) & self.mask
        out = (self.hash[slot] == values) & (self.times[slot] > 0) & ((self.doc[slot] < doc) | (self.doc[slot] == doc) & (self.start[slot] < start))
        now = slot[~out]
        self.hash[now], self.times[now], self.doc[now], self.start[now] = values[~out], 1, doc[~out], start[~out]
        return out


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return (textops.mix(keys ^ U64(0x5851F42D4C957F2D)) % U64(shards)).astype(np.int32)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (textops.mix(keys + U64(0x3C6EF372FE94F82B)) % U64(bits)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(shard, begin, end) of each stretch of a sorted array."""
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[: len(shard)]
    return shard[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(shard)).tolist() if len(cuts) else []


class Filter:
    """Bits by shard that say which hashes were found more than once, and which very often."""

    def __init__(self, given: dict[int, tuple[bytes, bytes]], shards: int, bits: int):
        self.shards, self.bits = shards, bits
        self.known, self.often = np.zeros((shards, bits // 8), np.uint8), None
        for k, (x, hot) in given.items():
            self.known[k] = np.frombuffer(x, np.uint8)
            if hot:
                self.often = np.zeros_like(self.known) if self.often is None else self.often
                self.often[k] = np.frombuffer(hot, np.uint8)

    def _look(self, table: np.ndarray, values: np.ndarray) -> np.ndarray:
        place = _places(values, self.bits)
        return (table[_shards(values, self.shards), place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0

    def has(self, values: np.ndarray) -> np.ndarray:
        return self._look(self.known, values)

    def hot(self, values: np.ndarray) -> np.ndarray:
        return np.zeros(len(values), bool) if self.often is None else self._look(self.often, values)


def _repeated(docs: DataFrame, prepare: Callable, shards: int, bits: int, often: int | None = None) -> dict[int, tuple[bytes, bytes]]:
    """For each shard a Bloom filter of ``bits`` bits of the hashes that are found more than once,
    and one of those that are sent ``often`` times (empty if there is none).

    ``prepare()``, called once by a task, gives the function of (data, offsets, ids) that has the
    hashes of a slice of texts.
    """

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, hashes_of = Sent(), prepare()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offs = textops.text_buffer(b.column(1))
            for i, j in textops.slices(offs, _SLICE):
                values, n = np.unique(hashes_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ids[i:j]), return_counts=True)
                fresh = ~sent.twice(values, n)
                values, n = values[fresh], n[fresh]
                if not len(values):
                    continue
                # what is repeated already is sent twice
                values = np.concatenate([values, values[n > 1]])
                shard = _shards(values, shards)
                order = np.argsort(shard, kind="stable")
                of, begin, end = _by_shard(shard[order])
                values = values[order]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([values[x:y].tobytes() for x, y in zip(begin, end)], pa.binary())], names=["shard", "hashes"])

    def fill(table: pa.Table) -> pa.Table:
        values, n = np.unique(np.concatenate([np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]), return_counts=True)

        def filled(some: np.ndarray) -> bytes:
            have = np.zeros(bits, bool)
            have[_places(values[some], bits)] = True
            return np.packbits(have, bitorder="little").tobytes()

        hot = n >= (often or np.inf)
        return pa.table({"shard": table.column("shard").slice(0, 1), "filter": pa.array([filled(n > 1)], pa.binary()), "hot": pa.array([filled(hot) if hot.any() else b""], pa.binary())})

    sent = docs.mapInArrow(send, "shard int, hashes binary")
    rows = sent.groupBy("shard").applyInArrow(fill, "shard int, filter binary, hot binary").toArrow()
    return dict(zip(rows.column("shard").to_pylist(), zip(rows.column("filter").to_pylist(), rows.column("hot").to_pylist())))


def _pieces(head: np.ndarray, s: np.ndarray, h: np.ndarray, w: textops.Words, keys: Filter, windows: Filter, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(heads, first words) of the parts of runs whose windows may be repeated; under a hot key each
    window is a part of its own, with its own hash as key."""
    may = keys.has(head["key"]) | (head["twice"] > 0)
    head, s = head[may], s[may]
    if not len(head):
        return head, s
    n = head["windows"].astype(np.int64)
    at, run = _ranges(s, n), np.repeat(np.arange(len(head)), n)
    own = _run_hashes(h, at, np.full(len(at), window))
    some = windows.has(own)
    at, run, own = at[some], run[some], own[some]
    if not len(at):
        return head[:0], s[:0]
    hot = keys.hot(head["key"][run])
    new = np.append(True, (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1])) | hot
    first = np.flatnonzero(new)
    out = head[run[first]]
    out["start"] += (at[first] - s[run[first]]).astype(np.int32)
    out["windows"] = np.diff(np.append(first, len(at)))
    out["key"] = np.where(hot[first], own[first], out["key"])
    out["bytes"] = w.end[at[first] + out["windows"] + window - 2] - w.start[at[first]]
    return out, at[first]


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 8, shard_bytes: int = 2 << 20, filter_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, start, windows): windows start..start+windows-1 that occur earlier.

    ``docs``: ``doc_id`` (distinct, not null) and ``text``.  Earlier is a smaller ``doc_id``,
    or an earlier start in the same text.  Only windows that may be repeated travel with their words:
    Bloom filters of ``filter_bytes`` at most tell which; if they are too small for a corpus,
    more windows travel, and none is lost.
    """
    spark, salt = docs.sparkSession, textops.fresh_key()
    size = input_bytes(docs, "text")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    bits = max(1 << 10, min(filter_bytes * 8, size // 4) // shards // 8 * 8)

    def keys_of() -> Callable:
        return lambda data, offs, ids: _slice_runs(data, offs, ids, window, gram, salt)[0]["key"]

    keys = spark.sparkContext.broadcast(_repeated(docs, keys_of, shards, bits, _HOT))

    def windows_of() -> Callable:
        known = Filter(keys.value, shards, bits)

        def hashes(data: np.ndarray, offs: np.ndarray, ids: np.ndarray) -> np.ndarray:
            head, s, _, h, _ = _slice_runs(data, offs, ids, window, gram, salt)
            may = known.has(head["key"]) | (head["twice"] > 0)
            n = head["windows"][may].astype(np.int64)
            return _run_hashes(h, at := _ranges(s[may], n), np.full(len(at), window))

        return hashes

    windows = spark.sparkContext.broadcast(_repeated(docs, windows_of, shards, bits))

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        of_keys, of_windows, sent = Filter(keys.value, shards, bits), Filter(windows.value, shards, bits), Sent()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offs = textops.text_buffer(b.column(1))
            for i, j in textops.slices(offs, _SLICE):
                head, s, w, h, done = _slice_runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ids[i:j], window, gram, salt)
                head, s = _pieces(head, s, h, w, of_keys, of_windows, window)
                if len(head):
                    # equal parts of the slice's runs, and of what the task has sent, needn't travel again
                    own = _run_hashes(h, s, head["windows"].astype(np.int64) + window - 1)
                    first = _firsts(own)
                    first[first] = ~sent.earlier(own[first], head["doc"][first], head["start"][first])
                    done = np.concatenate([done, _spans(head[~first])])
                    head, s = head[first], s[first]
                shard = _shards(head["key"], shards)
                order = np.argsort(shard, kind="stable")
                head, s, shard = head[order], s[order], shard[order]
                size = head["bytes"].astype(np.int64)
                raw = np.append(w.data, np.uint8(32))
                at = _ranges(w.start[s], size + 1)  # words keep the white space between them; a space ends a run
                ends = np.cumsum(size + 1)
                at[ends - 1] = len(w.data)
                text = raw[at]
                of, begin, end = _by_shard(shard)
                rows = [of, [head[x:y].tobytes() for x, y in zip(begin, end)], [press.compress(text[ends[x] - size[x] - 1 : ends[y - 1]].tobytes()) for x, y in zip(begin, end)], [b""] * len(of)]
                if len(done):
                    for column, v in zip(rows, (int(ids[i]) % shards, b"", b"", done.tobytes())):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["shard", "head", "text", "done"])

    def search(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        done = [np.frombuffer(x, _SPAN) for x in table.column("done").to_pylist()]
        head = np.concatenate([np.frombuffer(x, _HEAD) for x in table.column("head").to_pylist()])
        if len(head):
            text = np.frombuffer(b"".join(unpack.decompress(x) for x in table.column("text").to_pylist() if x), np.uint8)
            size = head["bytes"].astype(np.int64) + 1
            order = np.lexsort((head["start"], head["doc"]))
            text = text[_ranges((np.cumsum(size) - size)[order], size[order])]
            done.append(earlier_windows(head[order], text.tobytes(), window, salt))
        got = np.concatenate(done)
        tidy()
        return pa.table({"doc_id": pa.array(got["doc"]), "start": pa.array(got["start"]), "windows": pa.array(got["windows"])})

    sent = docs.mapInArrow(send, "shard int, head binary, text binary, done binary")
    return sent.groupBy("shard").applyInArrow(search, "doc_id bigint, start int, windows int")


def _cut(joined: DataFrame, at: int, window: int) -> DataFrame:
    """``joined`` (its last column: the spans) with n_words, n_removed and the SHA-256 (lowercase
    hex) of the kept words joined by a space in their place, and the text in column ``at`` cut:
    itself where nothing is removed, else the kept words joined by a space."""
    names = joined.columns[:-1]

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offs = textops.text_buffer(b.column(at))
            for i, j in textops.slices(offs):
                part = b.slice(i, j - i)
                data, own = textops.text_buffer(part.column(at))
                w = textops.Words(data, own)
                gone = np.zeros(len(w.start) + 1, np.int32)
                lists = part.column(len(names))
                row = np.repeat(np.arange(j - i), np.asarray(lists.value_lengths().fill_null(0)))
                flat = lists.flatten()
                first = w.first[row] + np.asarray(flat.field("start"))
                np.add.at(gone, first, 1)
                np.add.at(gone, first + np.asarray(flat.field("windows")) + window - 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                total = np.append(0, np.cumsum(gone))
                removed = total[w.first[1:]] - total[w.first[:-1]]
                texts = part.column(at).to_pylist()
                sums = []
                for k, (a, z) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    if removed[k]:
                        keep = np.flatnonzero(~gone[a:z]) + a
                        left = b" ".join(w.data[x:y].tobytes() for x, y in zip(w.start[keep].tolist(), w.end[keep].tolist()))
                        texts[k] = left.decode()
                    else:
                        # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
                        left = b" ".join(w.data[own[k] : own[k + 1]].tobytes().split())
                    sums.append(hashlib.sha256(left).hexdigest())
                cols = [pa.array(texts, pa.string()) if c == at else part.column(c) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sums, pa.string())], names=[*names, "__colonnade_n_words", "__colonnade_n_removed", "__colonnade_sha256"])

    added = [T.StructField("__colonnade_n_words", T.LongType()), T.StructField("__colonnade_n_removed", T.LongType()), T.StructField("__colonnade_sha256", T.StringType())]
    schema = T.StructType([*joined.select(*names).schema.fields, *added])
    return joined.mapInArrow(cut, schema)


def _with_spans(docs: DataFrame, rows: DataFrame, window: int, gram: int, shard_bytes: int) -> DataFrame:
    spans = written(repeated_spans(rows, window, gram, shard_bytes), "spans")  # frees the shuffles before it
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("__colonnade_spans"))  # within one text
    return docs.join(per_doc.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, "__colonnade_spans")


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 8, shard_bytes: int = 2 << 20) -> DataFrame:
    """Every document with what is left of it: doc_id, n_words, n_removed, kept_text, kept_sha256.

    A word is removed if a window that covers it occurs earlier.  ``kept_text`` is the text
    itself where nothing is removed, else the kept words joined by a space.  A null text
    has no words and stays null; texts shorter than a window keep all their words.  Rows
    with a null ``doc_id`` take no part, and of rows that share one the first stands (see
    one_row_per_id).  Other columns are ignored.  An empty table gives no rows.
    """
    rows = one_row_per_id(docs, "doc_id", ["text"]).select(F.col("doc_id").cast("bigint"), "text")
    cut = _cut(_with_spans(rows, rows, window, gram, shard_bytes), 1, window)
    return cut.select("doc_id", F.col("__colonnade_n_words").alias("n_words"), F.col("__colonnade_n_removed").alias("n_removed"), F.col("text").alias("kept_text"), F.col("__colonnade_sha256").alias("kept_sha256"))


def remove_repeats_from(docs: DataFrame, window: int = 20, gram: int = 8, shard_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with its texts cut as by :func:`remove_repeats`, all its columns kept.

    ``n_chars``, if there, becomes the new text's length.  Documents of which no word is left
    go; those without words from the start stay.  A null ``doc_id``, or one that several rows
    have, names no document: such rows stay as they are, and nothing is held against them.
    """
    rows = unique_ids(docs.select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("bigint"), "text")
    cut = _cut(_with_spans(docs, rows, window, gram, shard_bytes), docs.columns.index("text"), window)
    left = cut.where("__colonnade_n_removed = 0 OR __colonnade_n_removed < __colonnade_n_words")
    return left.select(*[F.when(F.col("__colonnade_n_removed") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])

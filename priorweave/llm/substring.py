"""Substring dedup: an FM-index per shard finds every window of words that also starts earlier in the corpus.

Streaming all documents past the indexes of all shards would cost the square of the corpus, so text is dealt to shards by content:

1. A window's key is the smallest hash of its 6-word runs. Equal windows have equal keys, wherever they stand. Neighbouring
   windows of one key form a segment. Segments of keys that occur once in the corpus are dropped, by a Bloom filter of a fixed size;
   nothing that repeats is lost.
2. Equal segments (of key and content, 128 bits) are one row with their first place before anything is indexed, so a group of copies
   costs one row, and all windows of the other copies start earlier for certain. A key whose distinct segments have more words than
   half a shard, as at the ends of a passage that thousands of documents share, would be too much for one shard: its windows are
   dealt by their own hash instead, where equal ones meet.
3. Only the words of the other keys' distinct segments are fetched from their texts. A shard holds those of its keys, about
   SHARD_WORDS words. They are streamed past the shard's FM-index; where the matching statistic reaches a window, the interval of its
   suffixes gives the window's first place, and a window that starts later than that is reported.

Reported runs return to their documents by id and text hash, are merged, and the words they cover are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .fmindex import FMIndex
from .storage import Stash, arrow_batches, key_filter, maybe_in

WINDOW = 20
GRAM = 6
SHARD_WORDS = 400_000


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each n neighbours."""
    width = 1
    while 2 * width <= n:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def window_keys(grams: np.ndarray, window: int) -> np.ndarray:
    return sliding(grams, window - GRAM + 1, np.minimum)


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """The key at each place that is a window's smallest: as many of a key as places have it."""
    n = window - GRAM + 1
    keys = window_keys(grams, window)
    padded = np.concatenate([np.zeros(n - 1, K.U), keys, np.zeros(n - 1, K.U)])
    return grams[sliding(padded, n, np.maximum) == grams]


def _documents(column: pa.Array, window: int):
    """(place in the column, word hashes, run hashes) of each text of a window's length at least."""
    data, offsets = K.string_bytes(column)
    for i, j in K.slices(offsets):
        hashes, _, _, first = K.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=False)
        grams = K.run_hash(hashes, GRAM)
        for k in np.flatnonzero(np.diff(first) >= window).tolist():
            a, b = first[k], first[k + 1]
            yield i + k, hashes[a:b], grams[a : b - GRAM + 1]


def _anchor_counts(window: int):
    def run(batches):
        for batch in batches:
            found = [anchors(g, window) for _, _, g in _documents(batch.column(0), window)]
            keys, n = np.unique(np.concatenate([*found, np.zeros(0, K.U)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(keys)), pa.array(n)], ["key", "n"])

    return run


def _segments(window: int):
    """(k0, k1, text_hash, text) -> the runs of neighbouring windows of one key, with a hash of their words."""

    def run(batches):
        for batch in batches:
            at, columns = [np.zeros(0, np.int64)], [[np.zeros(0, bool if k == 4 else np.int64)] for k in range(5)]
            for i, hashes, grams in _documents(batch.column(3), window):
                own = window_keys(grams, window)
                edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                a, b = edge[:-1], edge[1:]
                places = np.sort(anchors(grams, window))
                twice = places[1:][places[1:] == places[:-1]]
                again = np.isin(own[a], twice) if len(twice) else np.zeros(len(a), bool)
                at.append(np.full(len(a), i))
                for c, x in zip(columns, (K.signed(own[a]), K.signed(_contents(hashes, a, b + window - 1)), a, b - a, again)):
                    c.append(x)
            whose = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([*(c.take(whose) for c in batch.columns[:3]), *(pa.array(np.concatenate(c)) for c in columns)], [*ROW, "key", "content", "start", "windows", "again"])

    return run


def _spelled(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The words of each span, joined by spaces."""
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes + 1) - sizes - 1
    return [whole[a:b] for a, b in zip(begin[starts].tolist(), (begin + sizes)[ends - 1].tolist())]


def _contents(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, K.U), np.cumsum(hashes * K.powers(K.WORD_BASE, len(hashes)))])
    back = K.powers(pow(K.WORD_BASE, -1, 1 << 64), len(hashes))
    return K.mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(K.U))


def _spell(batches):
    """(k0, k1, text_hash, text, wanted) -> the words of each wanted segment."""
    for batch in batches:
        at, spelled, fields = [], [], [[], [], []]
        for i, (text, wanted) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            starts, windows = (np.array([w[k] for w in wanted], np.int64) for k in ("start", "windows"))
            at += [i] * len(wanted)
            spelled += _spelled(text.encode().split(), starts, starts + windows + wanted[0]["window"] - 1)
            for c, k in zip(fields, ("shard", "start", "windows")):
                c += [w[k] for w in wanted]
        whose = pa.array(at, pa.int64())
        words = pa.array(spelled, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*(c.take(whose) for c in batch.columns[:3]), *(pa.array(c, pa.int64()) for c in fields), words], [*ROW, "shard", "start", "windows", "words"])


def _windows(window: int):
    """(k0, k1, text_hash, start, windows, words) of a segment -> (k0, k1, text_hash, start, content) of each of its windows."""

    def run(batches):
        for batch in batches:
            starts, windows = (batch.column(k).to_numpy() for k in (3, 4))
            data, offsets = K.string_bytes(batch.column(5))
            at, begins, contents = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, K.U)]
            for i in range(batch.num_rows):
                part = data[offsets[i] : offsets[i + 1]]
                hashes, _, _, _ = K.word_hashes(part, np.array([0, len(part)]), lower=False)
                a = np.arange(windows[i])
                at.append(np.full(len(a), i))
                begins.append(starts[i] + a)
                contents.append(_contents(hashes, a, a + window))
            whose = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([*(c.take(whose) for c in batch.columns[:3]), pa.array(np.concatenate(begins)), pa.array(K.signed(np.concatenate(contents)))], [*ROW, "start", "content"])

    return run


def _search(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        starts, windows = group["start"].to_numpy(), group["windows"].to_numpy()
        data, offsets = K.string_bytes(pa.array(group["words"], pa.string()))
        hashes, _, _, first = K.word_hashes(data, offsets, lower=False)
        names, numbers = np.unique(hashes, return_inverse=True)
        n = len(group)
        owner = np.repeat(np.arange(n), windows + window - 1)
        place = np.arange(len(hashes)) + owner
        text = np.zeros(len(hashes) + n, np.int64)
        text[place] = numbers + 1
        index = FMIndex(text, len(names) + 1)
        inside = np.arange(len(hashes)) - first[owner]
        at = np.flatnonzero(inside < windows[owner])
        length, low, high = index.matching(text, place[at] + window, window)
        found = length >= window
        at, low, high = at[found], low[found], high[found]
        whose = group["k1"].to_numpy()[owner], group["k0"].to_numpy()[owner], starts[owner] + inside
        order = np.lexsort(whose[::-1])
        same = np.ones(len(order), bool)
        same[1:] = np.any([x[order][1:] != x[order][:-1] for x in whose], axis=0)
        priority = np.full(len(text), len(text), np.int64)
        priority[place[order]] = np.cumsum(same)
        hit = at[index.least(low, high, priority) < priority[place[at]]]
        begins = starts[owner[hit]] + inside[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(owner[hit]) != 0) | (np.diff(begins) != 1)
        last = np.append(new[1:], True)[: len(hit)]
        return group[ROW].iloc[owner[hit][new]].assign(a=begins[new], b=begins[last])

    return run


def _kept(texts: list, spans: list, window: int):
    """(words, words removed, the rest joined by spaces) of each text."""
    for text, own in zip(texts, spans):
        words = (text or "").encode().split()
        change = np.zeros(len(words) + 1, np.int64)
        for s in own or ():
            change[s["a"]] += 1
            change[s["b"] + window] -= 1
        keep = np.cumsum(change[:-1]) == 0
        left = [words[i] for i in np.flatnonzero(keep).tolist()] if not keep.all() else words
        yield len(words), len(words) - len(left), b" ".join(left)


def _digests(window: int):
    def run(batches):
        for batch in batches:
            found = list(_kept(batch.column(1).to_pylist(), batch.column(2).to_pylist(), window))
            sizes = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _cleaned(window: int, schema):
    """Rows of documents and their spans -> the rows with the words that are left, without those that lose all."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            found = list(_kept(batch.column(names.index("text")).to_pylist(), batch.column(names.index("_spans")).to_pylist(), window))
            texts = [x[2].decode() for x in found]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
            out = pa.RecordBatch.from_arrays([new[c].cast(batch.column(names.index(c)).type) if c in new else batch.column(names.index(c)) for c in schema.names], schema.names)
            yield out.filter(pa.array([bool(x) for x in texts], pa.bool_()))

    return run


ROW = ["k0", "k1", "text_hash"]


def _keys(id_col: str, text_col: str) -> dict:
    own = F.col(id_col).cast("long")
    return {"k0": F.coalesce(own, F.lit(0)), "k1": own.isNotNull(), "text_hash": F.xxhash64(F.col(text_col).cast("string"))}


def repeats(docs: DataFrame, id_col: str, text_col: str, window: int, stash: Stash) -> DataFrame:
    """(k0, k1, text_hash, spans): for each text with a repeated window, the runs a..b of starts of windows that also start earlier."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least, as its key is the hash of so many")
    arrow_batches(docs.sparkSession)
    rows = docs.select(*(c.alias(k) for k, c in _keys(id_col, text_col).items()), F.col(text_col).cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(_anchor_counts(window), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    bits = stash.keep(key_filter(counts.filter("n > 1"), "key"))
    # keys that the filter lets pass though they occur once have one segment, which does no harm below
    each = rows.mapInArrow(_segments(window), "k0 long, k1 boolean, text_hash long, key long, content long, start long, windows long, again boolean")
    each = stash.keep(maybe_in(each, bits, "key").filter("_maybe").drop("_maybe"), bits)
    first = F.min(F.struct("k1", "k0", "start", "text_hash")).alias("first")
    distinct = each.groupBy("key", "content").agg(first, F.count("*").alias("n"), F.max("again").alias("again"), F.first("windows").alias("windows"))
    distinct = stash.keep(distinct.select("key", "content", "first.*", "n", "again", "windows"))
    firsts = distinct.filter("n > 1").select("key", "content", F.col("k0").alias("f0"), F.col("k1").alias("f1"), F.col("start").alias("first_start"))
    bits = stash.keep(key_filter(firsts, "key", "content"))
    copies = maybe_in(each, bits, "key", "content").filter("_maybe").join(firsts, ["key", "content"])
    later = F.expr("k0 <> f0 or k1 <> f1 or start <> first_start")
    spans = [stash.keep(copies.filter(later).select(*ROW, F.col("start").alias("a"), (F.col("start") + F.col("windows") - 1).alias("b")), each, bits)]
    words = F.col("windows") + window - 1
    kinds = distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.max("again").alias("again"), F.sum(words).alias("words"))
    kinds = stash.keep(kinds.filter("kinds > 1 or again").select("key", "words"))
    hot = F.col("words") > SHARD_WORDS // 2
    size = kinds.filter(~hot).agg(F.sum("words")).first()[0] or 0
    shard = F.when(~hot, F.pmod(F.xxhash64("key"), F.lit(-(-size // SHARD_WORDS) or 1)))
    bits = stash.keep(key_filter(kinds, "key"))
    several = maybe_in(distinct.select("key", *ROW, "start", "windows"), bits, "key").filter("_maybe").join(kinds, "key")
    wanted = several.groupBy(*ROW).agg(F.collect_list(F.struct(shard.alias("shard"), "start", "windows", F.lit(window).alias("window"))).alias("wanted"))
    wanted = stash.keep(wanted, distinct, kinds, bits)
    bits = stash.keep(key_filter(wanted, *ROW))
    texts = maybe_in(rows, bits, *ROW).filter("_maybe").dropDuplicates(ROW).join(wanted, ROW).select(*ROW, "text", "wanted")
    pieces = stash.keep(texts.mapInArrow(_spell, "k0 long, k1 boolean, text_hash long, shard long, start long, windows long, words string"), wanted, bits)
    dealt = pieces.filter("shard is not null")
    spans.append(stash.keep(dealt.groupBy("shard").applyInPandas(_search(window), "k0 long, k1 boolean, text_hash long, a long, b long")))
    single = pieces.filter("shard is null").select(*ROW, "start", "windows", "words")
    single = stash.keep(single.mapInArrow(_windows(window), "k0 long, k1 boolean, text_hash long, start long, content long"), pieces)
    earliest = single.groupBy("content").agg(F.min(F.struct("k1", "k0", "start")).alias("first"))
    earliest = stash.keep(earliest.select("content", F.col("first.k0").alias("f0"), F.col("first.k1").alias("f1"), F.col("first.start").alias("first_start")))
    spans.append(single.join(earliest, "content").filter(later).select(*ROW, F.col("start").alias("a"), F.col("start").alias("b")))
    found = spans[0].union(spans[1]).union(spans[2]).groupBy(*ROW).agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    found = stash.keep(found)
    stash.only(found)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row.

    A window that occurs earlier (smaller id, or same id and smaller start) is covered with all its words. A null text has no words,
    a null id comes before all others. Rows of one id and text are one document and give the same result; rows of one id with
    different texts are compared by start. Other columns are ignored. A window below GRAM words is refused.
    """
    stash = Stash(docs.sparkSession, "substring")
    spans = repeats(docs, id_col, text_col, window, stash)
    bits = stash.keep(key_filter(spans, *ROW))
    keys = _keys(id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(c.alias(k) for k, c in keys.items()))
    split = maybe_in(rows, bits, *ROW)
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    sure = split.filter("not _maybe").select("doc_id", "text", F.lit(None).cast("array<struct<a: long, b: long>>").alias("_spans"))
    some = split.filter("_maybe").join(spans, ROW, "left").select("doc_id", "text", "_spans")
    return sure.mapInArrow(_digests(window), kind).union(some.mapInArrow(_digests(window), kind))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words that remain, joined by spaces, as text where words were removed; rows that lose all their words go.

    Rows are told apart by id and text, so null and shared ids do no harm. Rows without a repeat pass as they are, without a shuffle.
    """
    stash = Stash(docs.sparkSession, "substring")
    spans = repeats(docs, "doc_id", "text", window, stash)
    bits = stash.keep(key_filter(spans, *ROW))
    own = {f"_{k}": c for k, c in _keys("doc_id", "text").items()}
    split = maybe_in(docs.withColumns(own), bits, *own)
    some = split.filter("_maybe").join(spans.withColumnsRenamed(dict(zip(ROW, own))), [*own], "left")
    changed = some.filter("_spans is not null").select(*docs.columns, "_spans").mapInArrow(_cleaned(window, docs.schema), docs.schema)
    return split.filter("not _maybe").select(docs.columns).union(some.filter("_spans is null").select(docs.columns)).union(changed)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

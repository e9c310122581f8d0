"""MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard on full sets.

One 64-bit hash orders the 5-word shingles of a document; its k smallest values are its bottom-k sketch. Documents of equal
sets are one node from the start, so a group of copies costs one row. Two nodes are compared when they share a retained value:

1. Inverted lists of the 20 smallest values. Two sets of similarity 0.75 share none of them with a chance below 1e-12, and sets of up
   to 79 shingles always share one, as fewer than 20 of a set's values can be missing in the other.
   A list names a leader and compares it with all members; components then merge most of the list. Next, short lists whose members
   still lie in several components make all pairs across them.
2. Members of longer lists (a passage that thousands of otherwise different texts share) go to lists of 128 retained values, of
   which only the rarest are used: sharing m values of which c are needed, two sketches must meet in the m-c+1 rarest ones. A text
   that has most of its values for itself is in no such list.
3. What is left are large groups of near copies. Their lists hold the rarest of all values of each set, and where a set stands in the
   order of rarity bounds what a pair can share, which rules out the pairs of much edited copies before they are made.

No list, pair or row is capped.

Pairs pass the union-sketch estimate (bottom 64) and then the exact test on full sets. Full sets are made again from the texts that a
pair asks for, found by id and hash: a Bloom filter of a fixed size keeps all other texts where they are. All tables are shuffled by
value, node or pair; the driver holds only counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .storage import Stash, arrow_batches, key_filter, maybe_in

RETAINED = 20
WIDE = 128
ESTIMATE = 64
SMALL = 4
LENGTHS = [2 * SMALL * 16**i for i in range(6)]
#: Two sets of the least similarity share none of their RETAINED smallest values with a chance of 0.25 ** 20, and fail the test on
#: sketches, or that of common wide values, with a chance below this.
MISS = 1e-12


def shingle_sets(column: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, a list for each slice of the column."""
    data, offsets = K.string_bytes(column)
    for i, j in K.slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hashes, _, _, first = K.word_hashes(part, at, lower=True)
        runs = K.run_hash(hashes, words)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(runs[a : b - words + 1]))
            elif b > a:
                out.append(K.mix(K.run_hash(hashes[a:b], b - a) + K.U(b - a)))
            else:
                out.append(hashes[:0])
        yield out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    return int(K.mix(s).sum(dtype=K.U).view(np.int64)), int(K.mix(s ^ K.U(0x5851F42D4C957F2D)).sum(dtype=K.U).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, K.U)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(K.signed(flat)))


def _signatures(words: int):
    """(doc_id, text_hash, text) -> the size and digest of its set, its first lists' values and its smallest values."""

    def run(batches):
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(2), words):
                d = np.array([_digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                own = [c.slice(at, len(sets)) for c in batch.columns[:2]]
                sizes, wide = pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:WIDE].tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, sizes, pa.array(d[:, 0]), pa.array(d[:, 1]), _lists([s[:RETAINED] for s in sets]), wide], ["doc_id", "text_hash", "n", "h1", "h2", "low", "wide"])
                at += len(sets)

    return run


def _full_sets(words: int):
    """(node, h2, text) -> (node, n, set); rows whose text has another set than the node's are left out."""

    def run(batches):
        for batch in batches:
            nodes, seconds, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            for sets in shingle_sets(batch.column(2), words):
                keep = [i for i, s in enumerate(sets) if _digest(s) == (nodes[at + i], seconds[at + i])]
                got = [sets[i] for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + len(sets)][keep]), pa.array([len(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["node", "n", "shingles"])
                at += len(sets)

    return run


def _sketches(batches):
    """(node, n, wide) -> (node, n, sketch): the upper halves of the ESTIMATE smallest values."""
    for batch in batches:
        halves = [np.unique((np.frombuffer(b, K.U)[:ESTIMATE] >> K.U(32)).astype(np.uint32)).tobytes() for b in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(halves, pa.binary())], ["node", "n", "sketch"])


def overlap(a: bytes, b: bytes, k: int | None = None, kind=K.U) -> tuple[int, int]:
    """Common and all values of two sorted sets, or of the k smallest values of their union."""
    x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:] == both[:-1]
    if k is None:
        common = int(twice.sum())
        return common, len(both) - common
    new = np.concatenate([[True], ~twice])
    rank = np.cumsum(new)
    return int((twice & (rank[1:] <= k)).sum()), min(k, int(rank[-1]))


def least_common(k: int, percent: int) -> int:
    """So many of the k smallest values of a union are common to sets of that similarity, but for a chance below MISS."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > MISS:
            return c
    return k


def _alike(percent: int):
    """Pairs whose sketches may belong to similar sets. Halves of values may collide, so one more common value is granted to small sets."""
    least = least_common(ESTIMATE, percent)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                common, union = overlap(x, y, ESTIMATE, np.uint32)
                keep.append(common >= least if union >= ESTIMATE else 100 * (common + 1) >= percent * union)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            found = (overlap(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array([100 * c >= percent * u for c, u in found], pa.bool_()))

    return run


def _with(pairs: DataFrame, table: DataFrame, column: str, percent: int) -> DataFrame:
    """(a, b, x, y): the pairs of fitting sizes with that column of both nodes."""
    x = table.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col(column).alias("x"))
    y = table.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "x", "y")


class Sets:
    """Sketches of the nodes that share a value with another, and the full sets of those that a pair asks for.

    heads: (node, h2, k0, k1, text_hash, n, wide), k0 and k1 being the id of a document with that set and whether it has one.
    """

    def __init__(self, texts: DataFrame, heads: DataFrame, words: int, percent: int, stash: Stash):
        self.texts, self.heads, self.words, self.percent, self.stash = texts, heads, words, percent, stash
        self.known = None  # full sets of all nodes that pairs can still ask for, once such a table is there
        self.sketches = stash.keep(heads.select("node", "n", "wide").mapInArrow(_sketches, "node long, n long, sketch binary"))

    def full(self, nodes: DataFrame) -> DataFrame:
        """(node, n, shingles) of those nodes. Of the texts only those travel that a filter of the wanted ones lets pass."""
        wanted = self.stash.keep(self.heads.join(nodes, "node").select("node", "h2", *ROW))
        rows = maybe_in(self.texts, key_filter(wanted, *ROW), *ROW).filter("_maybe").dropDuplicates(ROW).select(*ROW, "text")
        sets = rows.join(wanted, ROW).select("node", "h2", "text").mapInArrow(_full_sets(self.words), "node long, n long, shingles binary")
        return self.stash.keep(sets, wanted)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose full sets are similar enough; the table of pairs goes."""
        likely = self.stash.keep(_with(pairs, self.sketches, "sketch", self.percent).mapInArrow(_alike(self.percent), "a long, b long"), pairs)
        if likely.isEmpty():
            return likely
        nodes = likely.select(F.col("a").alias("node")).union(likely.select("b"))
        if self.known is None:
            sets = self.full(nodes.distinct())
        else:
            sets = self.stash.keep(maybe_in(self.known, key_filter(nodes, "node"), "node").filter("_maybe").drop("_maybe"))
        return self.stash.keep(_with(likely, sets, "shingles", self.percent).mapInArrow(_similar(self.percent), "a long, b long"), likely, sets)


def _relabel(labels: DataFrame, links: DataFrame, stash: Stash) -> DataFrame:
    """labels after the links, as a table; the tables of both go."""
    if links.isEmpty():
        stash.drop(links)
        return labels
    x, y = (labels.select(F.col("node").alias(n), F.col("lab").alias(f"l{n}")) for n in "ab")
    merged = components(links.join(x, "a").join(y, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), stash)
    root = merged.select(F.col("node").alias("lab"), F.col("lab").alias("root"))
    return stash.keep(labels.join(root, "lab", "left").select("node", F.coalesce("root", "lab").alias("lab")), labels, links, merged)


STATE = ["node", "own", "rest", "needed", "size"]
ROW = ["k0", "k1", "text_hash"]


def _resolve(postings: DataFrame, labels: DataFrame, sets: Sets, rounds: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Compares what the lists (value, node, own, rest, needed, size) ask for; returns the labels and the lists left after the rounds.

    own: how many of a node's values no other node has. rest: how many values it has from this list's on, in the order of rarity;
    needed: how many a similar set must share; size: the whole set's, null where only a sketch is in the lists. A pair meets first in
    the list of its rarest common value, so it can share no more than the smaller rest: most pairs of a long list fail that before
    they are made. All four are null where the lists have no such order.

    The first round compares with leaders only, those with the fewest own values. From then on lists of few components make all
    pairs across them, and what few means grows with each round; without an order only short lists do. Where the rounds go on
    to the end, few means at once as many as make no more pairs than the first round had postings.
    """
    stash, percent, t, small, spare = sets.stash, sets.percent, 0, 0, 0
    may = F.least("rest", "rest_a")
    exact = F.col("size").isNull() | F.col("size_a").isNull() | (100 * may >= percent * (F.col("size") + F.col("size_a") - may))
    close = F.col("rest").isNull() | ((may >= F.greatest("needed", "needed_a")) & exact)
    while True:
        here = stash.keep(postings.join(labels, "node").select("value", "lab", *STATE), postings)
        parts = here.groupBy("value", "lab").agg(F.count("*").alias("c"), F.max("rest").alias("rest"))
        lists = parts.groupBy("value").agg(F.max(F.struct("c", "lab")).alias("most"), F.sum("c").alias("m"), F.max("rest").alias("rest"))
        others = F.col("m") - F.col("most.c")
        lists = lists.select("value", F.col("most.lab").alias("main"), others.alias("others"), "m", F.when(F.col("rest").isNull(), F.col("m")).otherwise(others).alias("length"))
        lists = stash.keep(lists.filter("others > 0"))
        work = [F.sum(F.when(F.col("length") <= s, F.col("others") * F.col("m"))) for s in LENGTHS]
        there, *made = lists.agg(F.sum("m"), *work).first()
        if not there:
            stash.drop(here, lists)
            return labels, None
        if rounds is not None and t >= rounds:
            return labels, stash.keep(here.join(lists.select("value"), "value").select("node").distinct(), here, lists)
        spare = spare or there
        if t and rounds is None:
            small = max([small, *(s for s, pairs in zip(LENGTHS, made) if (pairs or 0) <= spare)])
        few, many = lists.filter(F.col("length") <= small), lists.filter(F.col("length") > small)
        as_a = [F.col("lab").alias("la"), *(F.col(c).alias(f"{c}_a") for c in STATE)]
        outside = here.join(few, "value").filter("lab <> main").select("value", "main", *as_a)
        across = here.join(outside, "value").filter((F.col("lab") != F.col("la")) & ((F.col("lab") == F.col("main")) | (F.col("node") < F.col("node_a"))) & close)
        long = stash.keep(here.join(many, "value").select("value", "lab", *STATE))
        first = F.min(F.struct("own", F.xxhash64("node", F.lit(t)).alias("h"), "node", "lab", "rest", "needed", "size")).alias("first")
        leaders = long.groupBy("value").agg(first).select("value", "first.*")
        leaders = stash.keep(leaders.select("value", *as_a))
        led = long.join(leaders, "value").filter((F.col("lab") != F.col("la")) & close)
        pairs = across.select("node_a", "node").union(led.select("node_a", "node"))
        pairs = stash.keep(pairs.select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct(), here, lists)
        labels = _relabel(labels, sets.confirmed(pairs), stash)
        postings = stash.keep(long.join(leaders.select("value", "node_a"), "value").filter("node <> node_a").select("value", *STATE), long, leaders)
        small = 16 * small or 2 * SMALL
        t += 1


def _rare_postings(left: DataFrame, sets: Sets, wide: int | None) -> DataFrame:
    """(value, node, own, rest, needed, size) for the rarest retained values of each node, as many as a similar set must meet.

    Retained are the `wide` smallest values or, if None, all.
    """
    stash = sets.stash

    def unpack(batches):
        for batch in batches:
            parts = [np.frombuffer(b, K.U) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(parts)], ["node", "n", "low"])

    whole = sets.full(left) if wide is None else sets.heads.join(left, "node").select("node", "n", F.col("wide").alias("shingles"))
    rows = stash.keep(whole.select("node", "n", "shingles").mapInArrow(unpack, "node long, n long, low array<long>"), left)
    if wide is None:
        sets.known = whole
    each = rows.select("node", F.explode("low").alias("value"))
    shared = stash.keep(each.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    met = maybe_in(each, key_filter(shared, "value"), "value").filter("_maybe").join(shared, "value")
    ranked = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    kept, needed = F.col("n"), F.ceil(F.col("n") * sets.percent / 100)
    if wide is not None:
        kept, needed = F.least(kept, F.lit(wide)), F.least(needed, F.lit(least_common(wide, sets.percent)))
    own = kept - F.size("common")
    take = F.greatest(kept - needed + 1 - own, F.lit(0)).cast("int")
    size = F.when(F.col("n") == kept, F.col("n"))
    out = rows.select("node", "n").join(ranked, "node")
    out = out.select("node", own.alias("own"), kept.alias("kept"), needed.alias("needed"), size.alias("size"), F.posexplode(F.slice("common", F.lit(1), take)).alias("at", "x"))
    return stash.keep(out.select("x.value", "node", "own", (F.col("kept") - F.col("own") - F.col("at")).alias("rest"), "needed", "size"), rows, shared)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, Stash]:
    """(doc_id, text_hash, n, component_id, first_hash) of each row; first_hash with component_id names the row that a component keeps."""
    if percent < 75:
        raise ValueError("the retained values are chosen for a similarity of 0.75 or more")
    spark = docs.sparkSession
    arrow_batches(spark)
    stash = Stash(spark, "neardup")
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    texts = docs.select(own.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    key = {"k0": F.coalesce("doc_id", F.lit(0)), "k1": F.col("doc_id").isNotNull()}
    wide = stash.keep(texts.mapInArrow(_signatures(words), "doc_id long, text_hash long, n long, h1 long, h2 long, low array<long>, wide binary"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    nodes = wide.filter("n > 0").groupBy("h1", "h2").agg(least, F.first("low").alias("low"))
    nodes = stash.keep(nodes.select("h1", "h2", "least.*", "low"))
    each = nodes.select(F.col("h1").alias("node"), F.explode("low").alias("value"))
    shared = stash.keep(each.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1").select("value"))
    unknown = F.lit(None).cast("long")
    postings = maybe_in(each, key_filter(shared, "value"), "value").filter("_maybe").join(shared, "value")
    postings = stash.keep(postings.select("value", "node", *(unknown.alias(c) for c in STATE[1:])), shared)
    named = stash.keep(nodes.select("h1", "h2", "none", "doc_id", "text_hash"), nodes)
    met = stash.keep(postings.select("node").distinct())
    asked = stash.keep(named.join(met, named.h1 == met.node).withColumns(key).select("node", "h2", *ROW))
    heads = maybe_in(wide.withColumns(key).select(*ROW, "h2", "n", "wide"), key_filter(asked, *ROW), *ROW).filter("_maybe").dropDuplicates([*ROW, "h2"])
    heads = stash.keep(heads.drop("_maybe").join(asked, [*ROW, "h2"]))
    signed = stash.keep(wide.select("doc_id", "text_hash", "n", "h1", "h2"), wide, asked)
    sets = Sets(texts.withColumns(key), heads, words, percent, stash)
    labels = stash.keep(met.select("node", F.col("node").alias("lab")), met)
    labels, left = _resolve(postings, labels, sets, 2)
    for width, rounds in ((WIDE, 1), (None, None)):
        if left is not None:
            labels, left = _resolve(_rare_postings(left, sets, width), labels, sets, rounds)
    stash.only(signed, named, labels)
    named = stash.keep(named.join(labels.withColumnRenamed("node", "h1"), "h1", "left").withColumn("lab", F.coalesce("lab", "h1")), named, labels)
    roots = named.groupBy("lab").agg(F.min(F.struct("none", "doc_id", "text_hash")).alias("r"))
    roots = roots.select("lab", F.col("r.doc_id").alias("component_id"), F.col("r.text_hash").alias("first_hash"))
    classes = stash.keep(named.join(roots, "lab").select("h1", "h2", "component_id", "first_hash"), named)
    bare = signed.filter("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.col("text_hash").alias("first_hash"))
    full = signed.filter("n > 0").join(classes, ["h1", "h2"]).select(bare.columns)
    return full.union(bare), stash


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents whose shingle sets have 100*|A and B| >= percent*|A or B|.

    Returns doc_id, n_shingles, component_id, kept, one row for each input row. Null, empty and blank texts have no shingles and
    are linked with nothing. Rows of one id with different texts are different nodes; equal texts are one component whatever their
    ids. Null ids are the smallest of a component only where it has no other. Other columns are ignored. Below a similarity of 0.75
    the call is refused, as fewer retained values would be too few.
    """
    rows, _ = _classes(docs, id_col, text_col, words, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest id and, among rows of that id, of the smallest hash of the text.

    Null ids come last, so a row without an id stays only if it is like no row that has one. Of rows equal in id and text one stays.
    Rows without shingles are like no other row. Of rows that go or are repeated a filter is made; the others, most of all, pass
    without a shuffle.
    """
    rows, stash = _classes(docs, "doc_id", "text", 5, 75)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    keyed = rows.select(F.coalesce("doc_id", F.lit(0)).alias("k0"), F.col("doc_id").isNotNull().alias("k1"), "text_hash", stays.alias("stays"))
    odd = stash.keep(keyed.groupBy(*ROW).agg(F.max("stays").alias("_stays"), F.count("*").alias("_n")).filter("not _stays or _n > 1"))
    bits = stash.keep(key_filter(odd, *ROW))
    stash.only(odd, bits)
    own = {"_k0": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_k1": F.col("doc_id").isNotNull(), "_th": F.xxhash64(F.col("text").cast("string"))}
    split = maybe_in(docs.withColumns(own), bits, *own)
    sure = split.filter("not _maybe").select(docs.columns)
    doubt = split.filter("_maybe").join(odd.withColumnsRenamed(dict(zip(ROW, own))), [*own], "left").filter("_stays is null or _stays")
    once = doubt.filter("_stays").dropDuplicates([*own]).select(docs.columns)
    return sure.union(doubt.filter("_stays is null").select(docs.columns)).union(once)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

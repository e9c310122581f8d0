"""Document operators against brute force, on odd rows and on none."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from priorweave.llm import bm25, bpe, langid, mixing, neardup, sharding, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def test_bpe_equals_tiktoken_and_round_trips(spark, odd_docs, plain):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in plain:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(odd_docs).collect())) == want
    assert bpe.digests(odd_docs.filter("false")).count() == 0
    small = odd_docs.filter("doc_id < 0 or doc_id = 400").select("doc_id", "text")
    for r in bpe.decode(bpe.encode(small)).collect():
        assert r.decoded == (r.text or "")
        assert all(a <= b for a, b in zip(r.token_starts, r.token_ends))
    codec = bpe.codec(bpe.vocabulary_path())
    ids = next(codec.encode_batch(["漢字 split"]))[0]
    assert "".join(codec.stream([[i] for i in ids])) == "漢字 split"
    long = "word " * 300_000
    assert next(codec.encode_batch([long]))[0] == enc.encode_ordinary(long)


def test_sharding(spark, odd_docs, plain):
    got = sharding.shard_documents(odd_docs, shards=4).collect()
    n = len(plain)
    side = math.isqrt(n - 1) + 1

    def step(x):
        left, right = divmod(x, side)
        for i in range(sharding.ROUNDS):
            left, right = right, (left + int(hashlib.md5(f"shuffle-{i}-{right}".encode()).hexdigest()[:12], 16)) % side
        return left * side + right

    order = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, i) for i, t, *_ in plain)
    want = Counter()
    for k, (_, crc, size, i) in enumerate(order):
        p = step(k)
        while p >= n:
            p = step(p)
        want[i, size, crc, "rows", p % 4, p // 4, None, k] += 1
    assert Counter(map(tuple, got)) == want
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard_documents(odd_docs.filter("false")).count() == 0
    assert sharding.shard_documents(odd_docs.limit(1)).first().slot == 0


def near_brute(plain, percent=75):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t, *_ in plain:
        w = words((t or "").translate(low))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(plain)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(plain):
        least.setdefault(find(k), []).append(i)
    out = Counter()
    for k, (i, *_) in enumerate(plain):
        known = [x for x in least[find(k)] if x is not None]
        c = min(known) if known else None
        out[i, len(sets[k]), c, i == c] += 1
    return out


def test_near_duplicates(spark, odd_docs, plain):
    assert Counter(map(tuple, neardup.near_duplicates(odd_docs).collect())) == near_brute(plain)
    assert neardup.near_duplicates(odd_docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(odd_docs, percent=50)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """A group of near copies and a passage that many texts share, so that all three kinds of lists are used."""
    import random

    rng = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(80), rng.randint(1, 5)):
            w[j] = f"e{rng.randint(0, 3)}" if rng.random() < 0.5 else f"u{i}-{j}"
        rows.append((i, " ".join(w)))
    passage = [f"p{i}" for i in range(30)]
    rows += [(1000 + i, " ".join(passage + [f"q{i}-{j}" for j in range(rng.randint(2, 40))])) for i in range(120)]
    monkeypatch.setattr(neardup, "SMALL", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == near_brute(rows)


def repeats_brute(plain, window=20):
    at = {}
    for i, t, *_ in plain:
        w = words(t)
        for s in range(len(w) - window + 1):
            key, here = tuple(w[s : s + window]), (i is not None, i or 0, s)
            at[key] = min(at.get(key, here), here)
    out = Counter()
    for i, t, *_ in plain:
        w = words(t)
        covered = [False] * len(w)
        for s in range(len(w) - window + 1):
            if at[tuple(w[s : s + window])] < (i is not None, i or 0, s):
                covered[s : s + window] = [True] * window
        out[i, len(w), sum(covered), hashlib.sha256(" ".join(x for x, c in zip(w, covered) if not c).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("shard_words, window", [(3000, 20), (60, 20), (3000, 45)])
def test_substring_dedup(spark, odd_docs, plain, monkeypatch, shard_words, window):
    """With 60 words a shard nearly every key is hot, so that its windows are dealt by their own hash."""
    monkeypatch.setattr(substring, "SHARD_WORDS", shard_words)
    assert Counter(map(tuple, substring.remove_repeats(odd_docs, window=window).collect())) == repeats_brute(plain, window)
    if shard_words == 60:
        assert substring.remove_repeats(odd_docs.filter("false")).count() == 0
        with pytest.raises(ValueError):
            substring.remove_repeats(odd_docs, window=5)


@pytest.fixture(scope="module")
def unnamed(spark):
    """Copies, near copies and shared passages among documents without an id and documents that share one."""
    import random

    rng = random.Random(8)
    text = lambda n, of="abcdefgh": " ".join("".join(rng.choice(of) for _ in range(6)) for _ in range(n))
    base, passage = text(50), text(30)
    near = lambda i: " ".join([f"x{i}", *base.split()[1:]])
    rows = [(None, base), (None, near(1)), (None, text(40)), (None, text(40)), (None, None), (9, near(2)), (9, text(40)), (9, near(3)), (9, near(3)), (4, passage + " " + text(20))]
    rows += [(None, text(10) + " " + passage), (None, text(10) + " " + passage), (4, text(25) + " " + passage), (None, text(3))]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'a' as source", "cast(length(text) as long) as n_chars"), rows


def test_documents_without_an_id(spark, unnamed):
    """Rows are told apart by id and text: one row of a component stays, and only the rows that repeat words lose them."""
    df, rows = unnamed
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == near_brute(rows)
    left = Counter((r.doc_id, r.text) for r in neardup.without_near_duplicates(df).collect())
    like = {t for _, t in rows if t and t.split()[1:] == rows[0][1].split()[1:]}
    assert sum(n for (_, t), n in left.items() if t in like) == 1 and all(i == 9 for i, t in left if t in like)
    assert left - Counter({k: n for k, n in left.items() if k[1] in like}) == Counter((i, t) for i, t in rows if t not in like)
    assert Counter(map(tuple, substring.remove_repeats(df).collect())) == repeats_brute(rows)
    want = Counter(k[3] for k in repeats_brute(rows).elements() if k[1] > k[2])
    got = [r.text for r in substring.without_repeats(df).collect() if r.text is not None]
    assert Counter(hashlib.sha256(" ".join(words(t)).encode()).hexdigest() for t in got) == want


def test_index_equals_counting():
    import random

    import numpy as np

    from priorweave.llm.fmindex import FMIndex

    rng = random.Random(4)
    for n in (1, 7, 60, 400):
        text = np.array([rng.randint(0, 3) for _ in range(n)])
        index = FMIndex(text, 4)
        rows = np.arange(len(text))
        where = index.locate(rows + 1)
        assert sorted(where.tolist()) == rows.tolist()
        assert [text[k:].tolist() for k in where] == sorted(text[k:].tolist() for k in rows)
        stream = np.array([rng.randint(0, 3) for _ in range(50)])
        length, low, high = index.matching(stream, np.arange(9, 51), 9)
        for end, found, a, b in zip(range(9, 51), length, low, high):
            at = lambda m: [k for k in rows if k + m <= len(text) and (text[k : k + m] == stream[end - m : end]).all()]  # noqa: B023, E731
            assert found == max([m for m in range(1, 10) if len(at(m)) > 1], default=0)
            if found:
                assert sorted(index.locate(np.arange(a, b)).tolist()) == at(found)


def test_mixing(spark, odd_docs, plain):
    got = mixing.mix(odd_docs).collect()
    size = Counter()
    for _, t, _, s in plain:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / share for s in order}
        over = [s for s in order if s not in full and target[s] > 2 * size[s]]
        if not over:
            break
        full |= set(over)
    taken = Counter()
    for r in got:
        s = None if r.no_source else r.source
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) < 1.001 for s in order)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(odd_docs).collect()), key=str)
    assert mixing.mix(odd_docs.filter("false")).count() == 0
    texts = mixing.mixed_texts(odd_docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sum(len(words(r.text)) for r in texts) == sum(taken.values())


def test_language_id(spark, odd_docs, plain):
    got = langid.identify(odd_docs, langid.learn(odd_docs)).collect()
    assert len(got) == len(plain)
    for r, (i, t, *_) in zip(got, plain):
        has = any(c.isalpha() for c in t or "")
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
    empty = odd_docs.filter("false")
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert langid.identify(odd_docs, langid.learn(empty)).filter("lang_pred <> 'und'").count() == 0
    codes, counts = langid.ngram_counts("Ab ab!")
    assert counts.sum() == 4 + 6 + 4  # letters, pairs with the gaps, threes without a gap in the middle


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.learn(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.filter("lang_pred = lang").count() >= 0.98 * out.count()


def test_toxicity(spark, odd_docs, plain):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None) for i in range(30)] + [(None, 1, 1), (3, None, 2)], "doc_id long, toxic int, quality int")
    got = toxicity.score(odd_docs, toxicity.learn(odd_docs, labels)).collect()
    assert len(got) == len(plain) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    empty = odd_docs.filter("false")
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0
    assert toxicity.score(odd_docs, toxicity.learn(odd_docs, labels.filter("false"))).filter("predicted = 1").count() == 0


def test_toxicity_finds_sentences(spark):
    rows = [(i, f"all is well here {i}. " + ("you utter scoundrel. " if i % 3 == 0 else "") + f"more text follows {i}.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).filter("held_out").collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got)
    assert {r.sentence.strip() for r in toxicity.offending(docs, model).collect()} == {"you utter scoundrel."}


@pytest.mark.parametrize("small", [False, True])
def test_bm25(spark, odd_docs, plain, monkeypatch, small):
    if small:
        monkeypatch.setattr(bm25, "SHARD_BYTES", 4000)
        monkeypatch.setattr(bm25, "BLOCK", 4)
        monkeypatch.setattr(bm25, "BLOCK_TERMS", 40)
    ask = odd_docs.filter(F.col("doc_id") % 20 == 0)
    got = {}
    for r in bm25.search(odd_docs, ask, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    terms = [(i, re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower())) for i, t, *_ in plain if i is not None]
    n, mean = len(terms), sum(len(w) for _, w in terms) / len(terms)
    df = Counter(w for _, ws in terms for w in set(ws))
    for q, ws in terms:
        if q % 20 or q == -20 or sum(1 for i, _ in terms if i == q) > 1:
            continue
        want = []
        for i, own in terms:
            tf = Counter(own)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in set(ws) if w in tf)
            if s > 0 and i != q:
                want.append((-round(s, 9), i))
        want.sort()
        assert [x[2] for x in sorted(got.get(q, []))] == pytest.approx([-s for s, _ in want[:5]])
    assert bm25.search(odd_docs.filter("false"), ask, 5).count() == 0
    assert bm25.search(odd_docs, ask.filter("false"), 5).count() == 0

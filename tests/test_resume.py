"""Flows that go on where they ended, and tables that are written, read and built once."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from priorweave.sources import readers as S
from priorweave.streaming import flows as E


@pytest.fixture
def feed(spark, tmp_path):
    """Adds events to a folder: feed(first, last)."""

    def add(first, last):
        rows = [(i, datetime(2024, 1, 1 + i % 20), i % 7, "click", 1.0, "{}") for i in range(first, last)]
        spark.createDataFrame(rows, E.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        return str(tmp_path)

    return add


def links(spark, sf):
    return E.events(spark, sf).select(F.col("user_id").alias("a"), (F.col("event_id") % 5).alias("b"))


def degrees(upto):
    out = {}
    for i in range(upto):
        for node in (i % 7, i % 5):
            out[node] = out.get(node, 0) + 1
    return out


def test_degrees_go_on(spark, feed, tmp_path):
    at = str(tmp_path / "kept")
    read = lambda sf: {r.node: r.deg for r in E.grow_degrees(links(spark, sf), "d", at).collect()}
    assert read(feed(0, 40)) == degrees(40)
    assert read(feed(40, 90)) == degrees(90)
    assert read(str(tmp_path)) == degrees(90)  # nothing new
    assert read(feed(90, 95)) == degrees(95)
    results = E.Results(spark, f"{at}/out")
    assert len(results.batches()) == 2
    # a batch that is run again, as after a loss between its output and its commit, counts once
    last = results.batches()[-1]
    new = spark.createDataFrame([(0, 3)], "node long, deg long")
    again = lambda: results.put(results.before(last).union(new).groupBy("node").agg(F.sum("deg").alias("deg")), last)
    again()
    once = sorted(map(tuple, results.last("node long, deg long").collect()))
    again()
    assert sorted(map(tuple, results.last("node long, deg long").collect())) == once


def test_aggregates_and_appends_go_on(spark, feed, tmp_path):
    count = lambda sf: {r.user_id: r.n for r in E.land_latest(E.events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")), "c", str(tmp_path / "c")).collect()}
    ids = lambda sf: sorted(r[0] for r in E.land(E.events(spark, sf).select("event_id"), "i", at=str(tmp_path / "i")).collect())
    sf = feed(0, 30)
    assert count(sf) == {u: len(range(u, 30, 7)) for u in range(7)} and ids(sf) == list(range(30))
    sf = feed(30, 50)
    assert count(sf) == {u: len(range(u, 50, 7)) for u in range(7)} and ids(sf) == list(range(50))


def test_results_without_batches(spark, tmp_path):
    assert E.Results(spark, str(tmp_path / "none")).last("node long").count() == 0


def test_writers_and_their_readers(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    pairs = [(1, 2, datetime(2024, 1, 2, 3, 4, 5, 678000)), (2, 3, None)]
    S.write_links(spark.createDataFrame(pairs, "src long, dst long, created timestamp"), at("links"))
    assert sorted(map(tuple, S.read_links(spark, at("links")).collect())) == pairs
    S.write_corpus(spark.createDataFrame([(1, pairs[0][2], "a\tb\né", 0)], "id long, created timestamp, text string, other int"), at("corpus"))
    assert [tuple(r) for r in spark.read.parquet(at("corpus")).collect()] == [(1, pairs[0][2], "a\tb\né")]
    S.write_metrics(spark.createDataFrame([("m", 0.123456, 3)], "method string, rate double, n int"), at("metrics"))
    assert [tuple(r) for r in spark.read.json(at("metrics")).select("method", "rate", "n").collect()] == [("m", 0.1235, 3)]
    S.write_blind(spark.createDataFrame([(1, "text", "A")], "n int, shown string, method string"), ["shown"], ["method"], at("blind"))
    assert sorted(spark.read.json(at("blind/items")).columns) == ["n", "shown"] and sorted(spark.read.json(at("blind/key")).columns) == ["method", "n"]
    S.write_turns(spark.createDataFrame([("d", {"a": "b"})], "key string, said map<string, string>"), at("turns"))
    (line,) = [x for p in (tmp_path / "turns").glob("*.json") for x in p.read_text().splitlines()]
    assert json.loads(line) == {"key": "d", "said": {"a": "b"}}
    (tmp_path / "in.bin").write_bytes(b"abc")
    (row,) = S.manifest(spark, at("in.bin")).collect()
    assert (row.bytes, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def test_what_is_missing_and_known(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    have = spark.createDataFrame([(1, "m", "p", "f"), (2, "m", "p", "old"), (3, "other", "p", "f")], "id long, model string, prefix string, fingerprint string")
    assert sorted(r.id for r in S.missing_vectors(items, have, "m", "p", "f").collect()) == [2, 3]
    models = spark.createDataFrame([("a", "d1"), ("b", None)], "name string, digest string")
    assert S.model_versions(models, ["a"]).first().digest == "d1"
    with pytest.raises(Exception, match="no digest: b"):
        S.model_versions(models, ["b"]).collect()


def test_cached_is_built_once(spark, tmp_path):
    built, path = [], str(tmp_path / "cache")

    def build():
        built.append(1)
        return spark.range(3)

    assert [S.cached(spark, path, build).count() for _ in range(2)] == [3, 3] and len(built) == 1
    (tmp_path / "cache/_SUCCESS").unlink()
    assert S.cached(spark, path, build).count() == 3 and len(built) == 2

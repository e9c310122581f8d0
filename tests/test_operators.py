"""Operators on small hand-made inputs, and what must hold whatever the data."""

import pytest
from pyspark.sql import functions as F

from priorweave.functions import text as X
from priorweave.operators import dialogue as D
from priorweave.operators import metrics as M
from priorweave.operators import models as L
from priorweave.operators import ranking as R
from priorweave.operators import timeline as T
from priorweave.plans.fixtures import vectors
from priorweave.sources import readers as S

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_positions_are_gapless_and_ordered(spark):
    df = spark.createDataFrame([(5, "b"), (None, "a"), (1, "c"), (5, "a")], "t int, k string")
    assert rows(T.positions(df, ["t", "k"]), "pos") == [(None, "a", 0), (1, "c", 1), (5, "a", 2), (5, "b", 3)]
    assert T.positions(df.filter("false"), ["t"]).count() == 0


def test_ties_go_to_the_older(spark):
    s = spark.createDataFrame([(9, d, 0.5) for d in (4, 2, 7)], "q int, d int, score double")
    assert [r[1] for r in rows(R.top_k(s, 2).select("q", "d", "rank"), "rank")] == [2, 4]


def test_interleave(spark):
    a = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate([1, 2, 3, 4, 5])], "q int, rank int, d int")
    b = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate([3, 1, 8])], "q int, rank int, d int")
    assert [r[2] for r in rows(R.interleave(a, b), "rank")] == [1, 3, 2, 8]
    assert [r[2] for r in rows(R.interleave(a, a), "rank")] == [1, 2, 3, 4, 5]


def test_rrf_of_equal_lists_keeps_the_order(spark):
    a = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate([7, 3, 5])], "q int, rank int, d int")
    assert [r[1] for r in rows(R.top_k(R.rrf([a, a]), 5).select("rank", "d"), "rank")] == [7, 3, 5]


def test_links_and_relations(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, [0.8, 0.6])], "pos long, v array<float>")
    links = spark.createDataFrame([(0, 1), (0, 1)], "a long, b long")
    adj = T.symmetric(links)
    assert rows(adj, "node") == [(0, 1), (1, 0)]
    nodes = R.node_table(adj, v, 2)
    own = R.score_table(v, v.filter("pos = 3").select("pos"), 5, nodes.select("node"))
    m = {r.d: r for r in R.link_scores(own, adj, nodes, v).collect()}
    assert m[1].own == 0.6 and m[1].nbr == 0.8 and m[1].cen == 0.98995 and m[1].m1 == m[1].cen
    assert m[2].m1 == m[2].own == 0.96
    none = adj.filter("false")
    plain = R.link_scores(own, none, R.node_table(none, v, 2), v)
    assert plain.filter("m1 <> own").count() == 0


def test_relations_never_lower_a_score_and_families_are_one_hop(spark):
    x = vectors(spark, SF)
    assert x.scores.filter("m1 < own").count() == 0
    assert x.lists.join(x.corpus.select(F.col("pos").alias("d")), "d", "left_anti").count() == 0
    assert x.lists.filter("d >= q").count() == 0
    gold = spark.createDataFrame([(9, 1)], "q long, d long")
    adj = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "node long, nbr long")
    assert rows(R.family(gold, adj), "d") == [(9, 1), (9, 2)]


def test_bm25_unknown_term_is_padded_with_the_oldest(spark):
    docs = spark.createDataFrame([(i, "a b c".split()[i % 3]) for i in range(30)], "pos long, text string")
    post = R.postings(docs, X.words(F.col("text")))
    sizes = docs.select(F.col("pos").alias("d"), F.lit(1).alias("dl"))
    q = spark.createDataFrame([(30, "zzz")], "q long, term string")
    top = R.top_k(R.lexical_scores(R.bm25_index(post, sizes, F.col("d") < 24), q), 5)
    assert top.count() == 0
    assert [r[1] for r in rows(R.padded(top, q.select("q"), sizes, 5).select("rank", "d"), "rank")] == [0, 1, 2, 3, 4]


def test_asof_last_edit_wins_and_fallback(spark):
    h = spark.createDataFrame([(1, "title", "2020-01-01", 1, "x"), (1, "title", "2020-01-01", 2, "y"), (2, "title", "2020-03-01", 1, "new"), (2, "title", "2020-04-01", 2, "newer")], "post int, kind string, ts string, seq int, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    made = spark.createDataFrame([(1, "2019-01-01"), (2, "2020-03-01")], "post int, created string").withColumn("created", F.col("created").cast("timestamp"))
    v = T.asof_version(h, made, "2020-02-01")
    assert rows(v, "post") == [(1, "title", "y"), (2, "title", "new")]
    cur = spark.createDataFrame([(1, "t1", "b1"), (3, "t3", "b3")], "post int, title string, body string")
    assert rows(T.with_fallback(v, cur, ["title", "body"]), "post") == [(1, "y", "b1"), (3, "t3", "b3")]


def test_acceptance_on_the_day_of_the_question_does_not_count(spark):
    q = spark.createDataFrame([(1, 7, "2020-05-05 12:00")], "q int, d int, asked string").withColumn("asked", F.col("asked").cast("timestamp"))
    a = spark.createDataFrame([(10, 7, "2020-01-01"), (11, 7, "2020-01-02")], "answer int, d int, created string").withColumn("created", F.col("created").cast("timestamp"))
    votes = spark.createDataFrame([(10, "accepted", "2020-05-05"), (11, "up", "2020-05-04")], "answer int, kind string, day string").withColumn("day", F.col("day").cast("date"))
    assert rows(T.best_answer(q, a, votes)) == [(1, 7, 11, "votes")]


def test_markdown(spark):
    md = "# Head\r\n\r\nText with [a link](http://x) and ![pic](y.png) and `code`.\n\n    indented one\n    indented two\n\n> quote &amp; more\n\n```\nfenced\n```\n[ref]: http://z\n"
    got = spark.createDataFrame([(md,)], "b string").select(X.clean_markdown(F.col("b"))).first()[0]
    assert got == "Head Text with a link and pic and code . indented one indented two quote & more fenced"


def test_texts_are_decoded(spark):
    """All character references, also those that no short list has; titles and bodies may be null."""
    df = spark.createDataFrame([("A &eacute; &#x4E2D;", "Bo <b>dy</b> &hellip; &notanentity;"), (None, None)], "t string, b string")
    got = df.select(X.final_text(F.col("t"), F.col("b")).alias("f"), X.html_text(F.col("b"), 3).alias("h")).collect()
    assert [tuple(r) for r in got] == [("a é 中 . bo <b>dy</b> &hellip; &notanentity;", "Bo dy …"), (".", "")]


def test_token_offsets_and_bio(spark):
    t = spark.createDataFrame([(1, "Go to São Paulo, now")], "id int, text string").select("id", F.posexplode(X.token_offsets(F.col("text"))).alias("i", "t")).select("id", "i", "t.*")
    assert [(r.token, r.start, r.end) for r in t.orderBy("i").collect()] == [("Go", 0, 2), ("to", 3, 5), ("São", 6, 9), ("Paulo", 10, 15), (",", 15, 16), ("now", 17, 20)]
    spans = spark.createDataFrame([(1, "city", 6, 15)], "id int, slot string, start int, end int")
    tags = D.span_labels(t, spans)
    assert [r.tag for r in tags.orderBy("i").collect()] == ["O", "O", "B-city", "I-city", "O", "O"]
    assert rows(L.decode_spans(tags.withColumn("p", F.lit(0.9)))) == [(1, "city", 6, 15, 0.9)]
    assert L.token_features(t).filter("i = 2").first().feats[0] == "w=são"


def test_longest_match(spark):
    toks = spark.createDataFrame([(1, ["new", "york", "city", "york"]), (2, [])], "id int, toks array<string>")
    index = spark.createDataFrame([("new york", "city"), ("york", "city"), ("york city", "team")], "value string, concept string")
    assert rows(D.longest_matches(toks, index)) == [(1, 0, 2, "new york", "city")]


def test_kappa_and_bootstrap(spark):
    j = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "q int, x int, y int")
    assert j.agg(*M.kappa("x", "y")).first().kappa == 1.0
    b = M.bootstrap(j.withColumn("g", F.lit(1)), F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")), 100, ("g",)).first()
    assert b.lo <= b.point <= b.hi


def test_threshold_and_correction(spark):
    s = spark.createDataFrame([(0.9, 1, True), (0.8, 0, True), (0.7, 0, True)], "score double, hit int, labelled boolean")
    assert M.threshold(s, 2.0).first()[0] == 0.8
    assert spark.range(1).select(M.corrected(F.lit(0.5), F.lit(0.1), F.lit(0.4))).first()[0] is None


def test_simulation_blend_and_policy(spark):
    turns = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "conv_id long, turn long, text string")
    step = lambda state, row: ((state or "") + row["text"], {"conv_id": row["conv_id"], "turn": row["turn"], "seen": state or ""})
    assert rows(D.simulate(turns, step, "conv_id long, turn long, seen string"), "conv_id", "turn") == [(1, 1, ""), (1, 2, "a"), (2, 1, "")]
    m = spark.range(1).select(D.blend(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("b"), F.lit(1.0)), 0.25).alias("m")).first().m
    assert m == {"a": 0.75, "b": 0.25}
    ask = lambda p, n, b, s: spark.range(1).select(D.decide(F.lit(p), F.lit(n), F.lit(b), F.lit(s))).first()[0]
    assert [ask(0.9, True, True, True), ask(0.9, False, True, True), ask(0.1, False, False, True), ask(0.9, False, True, False)] == ["block", "call", "ask", "refuse"]


def test_value_matches_equal_a_loop(spark):
    from priorweave.plans import registry

    index = {r.value for r in registry.QUERIES["value_index"](spark, SF).filter("concept = 'assistant'").collect()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'").select("conv_id", "turn", X.words(F.col("text")).alias("w")).collect()
    want = set()
    for r in turns:
        i = 0
        while i < len(r.w):
            n = next((n for n in (3, 2, 1) if " ".join(r.w[i : i + n]) in index and i + n <= len(r.w)), 0)
            if n:
                want.add((r.conv_id, r.turn, i, i + n, " ".join(r.w[i : i + n]), "assistant"))
                break  # a concept once
            i += 1
    assert set(rows(registry.QUERIES["value_matches"](spark, SF))) == want


def test_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('1\tTitle "q"\tBody\n2\tOnly\n')
    assert rows(S.read_corpus_tsv(spark, str(tmp_path / "c.tsv"))) == [(1, 'Title "q"', "Body"), (2, "Only", "")]
    (tmp_path / "p.txt").write_text("5\t1 2\t1 2 3\n6\t\t4\n")
    similar, candidates = S.read_pairs_tsv(spark, str(tmp_path / "p.txt"))
    assert rows(similar, "similar") == [(5, 1), (5, 2)] and candidates.count() == 4
    (tmp_path / "v.txt").write_text("a 1 2\nb 1 2 3\n")
    assert rows(S.read_word_vectors(spark, str(tmp_path / "v.txt"), 2)) == [("a", [1.0, 2.0])]
    (tmp_path / "x.xml").write_text('<posts><row Id="1" PostTypeId="1" CreationDate="2020-01-01T00:00:00.000" Title="T"/><row Id="2" PostTypeId="2" ParentId="1"/></posts>')
    assert [r.Id for r in S.read_xml_rows(spark, str(tmp_path / "x.xml"), S.POSTS).orderBy("Id").collect()] == [1, 2]
    (tmp_path / "kv.jsonl").write_text('{"a":1,"v":true}\nbad\n{"a":1,"v":false}\n')
    assert rows(S.read_key_values(spark, str(tmp_path / "kv.jsonl"), "a long, v boolean", ["a"])) == [(1, False)]
    d = tmp_path / "train"
    d.mkdir()
    (d / "d.json").write_text('[{"dialogue_id":"x","services":["S"],"turns":[{"speaker":"USER","utterance":"hi","frames":[]}]}]')
    assert S.read_dialogues(spark, str(d / "d.json")).first().key == "train/x"
    (tmp_path / "m.json").write_text('{"intents":{"buy":{"A":"Buy","B":null}},"slots":{}}')
    assert rows(S.read_mapping(spark, str(tmp_path / "m.json")), "service") == [("intents", "buy", "A", "Buy"), ("intents", "buy", "B", None)]
    labels = spark.createDataFrame([(1, " sim "), (2, "No")], "n int, label string")
    items = spark.createDataFrame([(1,), (2,)], "n int")
    assert rows(S.read_labels(labels, items, {"SIM": "yes", "NO": "no"}), "n") == [(1, "yes"), (2, "no")]
    with pytest.raises(Exception, match="without a label"):
        S.read_labels(labels, spark.createDataFrame([(3,)], "n int"), {"SIM": "yes"}).collect()
    calls = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    assert S.with_service(calls, "t", "n", lambda texts: [float(len(t)) for t in texts], "double").agg(F.sum("n")).first()[0] == 2.0

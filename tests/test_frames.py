"""Annotated dialogues: two services, read from JSON files, with the results written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from priorweave.operators import frames as A
from priorweave.operators import metrics as M
from priorweave.sources import readers as S


def action(act, slot="", values=(), canonical=None):
    return {"act": act, "slot": slot, "values": list(values), "canonical_values": list(values if canonical is None else canonical)}


def user(text, actions, intent, state, asked=()):
    frame = {"service": "Shows_1", "actions": actions, "slots": [], "state": {"active_intent": intent, "slot_values": state, "requested_slots": list(asked)}}
    return {"speaker": "USER", "utterance": text, "frames": [frame]}


def system(text, actions, call=None):
    frame = {"service": "Shows_1", "actions": actions, "slots": []}
    return {"speaker": "SYSTEM", "utterance": text, "frames": [frame | ({"service_call": call} if call else {})]}


TURNS = [
    user("A show in SF", [action("INFORM_INTENT", "intent", ["FindShow"]), action("INFORM", "city", ["SF"], ["San Francisco"])], "FindShow", {"city": ["SF"]}, ["when"]),
    system("What kind?", [action("REQUEST", "kind"), action("REQUEST", "kind")]),
    user("Music", [action("INFORM", "kind", ["Music"])], "FindShow", {"city": ["SF"], "kind": ["Music"]}),
    system("The Band on May 1?", [action("OFFER", "name", ["Other"]), action("OFFER", "name", ["The Band", "Band"]), action("OFFER", "when", ["May 1"]), action("GOODBYE")], {"method": "FindShow", "parameters": {"city": "San Francisco"}}),
    user("Yes", [action("SELECT"), action("AFFIRM")], "FindShow", {"city": ["SF"], "kind": ["Music"], "name": ["The Band"], "note": ["loud"]}),
    {"speaker": "SYSTEM", "utterance": "...", "frames": []},
    user("No, stop", [action("AFFIRM"), action("NEGATE")], "NONE", {"city": ["SF"], "kind": ["Music"], "name": ["The Band"], "note": ["loud"]}),
]


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("frames")
    (top / "train").mkdir()
    (top / "train/d.json").write_text(json.dumps([{"dialogue_id": "1", "services": ["Shows_1"], "turns": TURNS}, {"dialogue_id": "2", "services": ["Shows_1", "Taxi_1"], "turns": []}, {"dialogue_id": "3", "services": ["Taxi_1"], "turns": [{"speaker": "USER", "utterance": "hello", "frames": []}]}]))
    schema = [{"service_name": "Shows_1", "slots": [{"name": n, "is_categorical": n == "kind", "description": ""} for n in ("city", "kind", "name", "when")], "intents": [{"name": "FindShow", "required_slots": ["city"], "optional_slots": {"kind": "x", "note": "y"}}, {"name": "Buy", "required_slots": [], "optional_slots": {}}]}]
    (top / "train/schema.json").write_text(json.dumps(schema))
    mapping = {"intents": {"shows.find": {"Shows_1": "FindShow", "Shows_2": "Find"}, "shows.buy": {"Shows_1": None}}, "slots": {"place.city": {"Shows_1": "city"}, "show.name": {"Shows_1": "name"}, "show.kind": {"Shows_1": "kind"}}}
    (top / "mapping.json").write_text(json.dumps(mapping))
    return S.read_dialogues(spark, str(top / "train/d.json")), S.read_service_schemas(spark, str(top / "train/schema.json")), S.read_mapping(spark, str(top / "mapping.json"))


@pytest.fixture(scope="module")
def turns(read):
    return A.turns(read[0], read[2]).cache()


def got(turns, column):
    return [r[0] for r in turns.filter("key = 'train/1'").orderBy("turn").select(column).collect()]


def test_context_of_turns(turns):
    acts = A.system_acts(F.col("system"), F.col("slot_of"))
    assert got(turns, acts) == [["START"], ["REQUEST:show.kind"], ["GOODBYE", "OFFER:show.name", "OFFER:when"], ["START"]]
    assert got(turns, A.requested(acts)) == [[], ["show.kind"], [], []]
    assert got(turns, A.offered(F.col("system"), F.col("slot_of"))) == [{}, {}, {"show.name": "The Band", "when": "May 1"}, {}]
    assert got(turns, A.user_act(F.col("frame"))) == ["other", "other", "accept", "negate"]
    assert got(turns, "call.method") == [None, "FindShow", None, None]
    assert got(turns, A.asks_task(F.col("frame"))) == [True, False, False, False]
    assert turns.count() == 5  # a user turn without frames stays


def test_kinds_and_meanings(turns, read):
    of = read[1].select(F.map_from_entries(F.transform("slots", lambda s: F.struct(s["name"], s["is_categorical"]))).alias("categorical"))
    rows = turns.crossJoin(of)
    now = F.col("frame.state.slot_values")
    changed = F.map_filter(now, lambda k, v: ~v.eqNullSafe(F.element_at(F.col("before.slot_values"), k)))
    assert got(rows, F.array_sort(F.map_keys(changed))) == [["city"], ["kind"], ["name", "note"], []]
    assert got(rows, A.turn_kind(changed, F.col("categorical"))) == ["entity", "categorical", "entity", "no_value"]
    args = (F.col("frame.state.active_intent"), changed, F.col("frame.state.requested_slots"), F.col("slot_of"), F.col("intent_of"))
    plain = [(r.intent, [tuple(s) for s in r.slots], r.requested) for r in got(rows, A.interpretation(*args))]
    assert plain[0] == ("shows.find", [("place.city", ["SF"])], ["when"]) and plain[2] == ("shows.find", [("note", ["loud"]), ("show.name", ["The Band"])], [])
    bound = [[tuple(s) for s in r.slots] for r in got(rows, A.interpretation(*args, A.values_by_slot(F.col("system"))))]
    assert bound[2] == [("note", ["loud"]), ("show.name", ["FROM_SYSTEM"])] and bound[0] == [("place.city", ["SF"])]
    assert got(turns, A.renamed(now, F.col("slot_of")))[1] == {"place.city": ["SF"], "show.kind": ["Music"]}


def test_services_and_methods(read):
    dialogues, schemas, mapping = read
    s = F.col("services")
    rows = dialogues.orderBy("key").select(A.single_service(s), A.among_others(s, ["Shows_1"]), A.out_of_catalogue(s, ["Shows_1"])).collect()
    assert [tuple(r) for r in rows] == [(True, False, False), (False, True, False), (True, False, True)]
    assert [tuple(r) for r in A.methods(schemas, mapping).collect()] == [("Shows_1", "shows.find", "FindShow", ["place.city"], ["show.kind", "note"])]
    assert A.methods(schemas.filter("false"), mapping).count() == 0


def test_values(spark, read):
    rows = spark.createDataFrame([("city", "The City of it", False), ("city", "in a city", True), ("start_date", "", False), ("time", "", False), ("update", "capacity", False)], "n string, d string, c boolean")
    assert [r[0] for r in rows.select(A.concept_rule(F.col("n"), F.col("d"), F.col("c"))).collect()] == ["place.city", None, "event.date", "event.time", None]
    canon = read[0].filter("key = 'train/1'").select(A.canonical(F.col("turns")).alias("m")).first().m
    assert canon["sf"] == "san francisco" and canon["music"] == "music"
    said = spark.createDataFrame([("SF", ["san francisco"]), ("San Francisco", ["sf", "x"]), ("oakland", ["SF"]), (None, ["SF"]), ("a", [])], "p string, g array<string>").withColumn("m", F.create_map(F.lit("sf"), F.lit("san francisco")))
    assert [r[0] for r in said.select(A.equal_value(F.col("p"), F.col("g"), F.col("m"))).collect()] == [True, True, False, False, False]
    pairs = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3), (None, 4)],), ([],), (None,)], "p array<struct<k: string, v: int>>")
    assert [r[0] for r in pairs.select(A.latest(F.col("p"))).collect()] == [{"a": 3, "b": 2}, {}, None]
    lists = spark.createDataFrame([([1, 2], [2, 1, 1]), ([1, 2], [1, 2]), ([1], [2])], "x array<int>, y array<int>")
    assert [tuple(r) for r in lists.select(A.same_set(F.col("x"), F.col("y")), A.same_list(F.col("x"), F.col("y"))).collect()] == [(True, False), (True, True), (False, False)]


def test_features_of_decisions(spark):
    kind = "intent string, act string, required array<string>, optional array<string>, state array<string>, new array<string>, changed boolean, acts array<string>"
    rows = spark.createDataFrame([("buy", "accept", ["n"], ["d"], ["n", "x"], ["n"], True, ["CONFIRM:n", "CONFIRM:d"]), ("talk", "other", None, None, [], [], False, ["START"])], kind)
    out = [r[0] for r in rows.select(A.decision_features(*(F.col(c) for c in rows.columns))).collect()]
    assert out[0] == {"bias": 1, "intent=buy": 1, "act=accept": 1, "supported": 1, "req_complete": 1, "any_new": 1, "intent_changed": 1, "new_in_method": 1, "req_complete&buy": 1, "act=accept&prevCONFIRM": 1, "new=n": 1, "pa=CONFIRM:n": 1, "pa=CONFIRM:d": 1, "pact=CONFIRM": 1, "n_new": 1}
    assert out[1] == {"bias": 1, "intent=talk": 1, "act=other": 1, "pa=START": 1, "pact=START": 1, "n_new": 0}


CALL = "struct<method: string, parameters: map<string, string>>"
SCORED = f"app string, key string, intent string, state map<string, array<string>>, call {CALL}, canon map<string, string>, said_intent string, said map<string, string>, said_call {CALL}, direct boolean, ms double, pool string, support string"


def test_quality(spark):
    sf, find = {"sf": "san francisco"}, lambda city: ("Find", {"city": city})
    rows = [
        ("a", "1", "x", {"c": ["SF"]}, None, sf, "x", {"c": "San Francisco"}, None, False, 1.0, "served", "supported"),
        ("a", "1", "x", {"c": ["SF"]}, find("SF"), sf, "x", {"c": "sf", "d": "y"}, find("san francisco"), True, 2.0, "served", "out_of_catalog"),
        ("a", "2", "x", {"c": ["SF"], "d": ["z"]}, find("SF"), sf, "y", {"c": "LA"}, None, False, 3.0, "outside", "out_of_catalog"),
        ("a", "2", "x", {}, find("SF"), sf, "x", {}, find("LA"), True, 4.0, "outside", "supported"),
        ("a", "3", "x", {}, find("SF"), sf, "x", {}, ("Buy", {"city": "SF"}), False, 5.0, "outside", "out_of_catalog"),
        ("b", "4", "x", {}, None, None, "x", {}, find("SF"), False, 9.0, "probe", "known_unsupported"),
    ]
    s = A.scored(spark.createDataFrame(rows, SCORED)).cache()
    assert [tuple(r) for r in s.orderBy("ms").select("state_ok", "slot_tp", "method_ok", "args_ok", "right").collect()] == [(True, 1, None, None, True), (False, 1, True, True, True), (False, 0, None, None, False), (True, 0, True, False, False), (True, 0, False, True, False), (True, 0, None, None, False)]
    q = {r.app: r for r in A.quality(s).collect()}
    a = q["a"]
    assert (a.turns, a.intent_accuracy, a.full_state, a.slot_precision, a.slot_recall) == (5, 0.8, 0.6, 0.5, 0.5)
    assert (a.calls_gold, a.calls_said, a.unwarranted, a.omitted, a.quality, a.direct, a.direct_right, a.ms_median) == (4, 3, 0, 1, 0.4, 0.4, 0.5, 3.0)
    assert (a.method_ok, a.args_ok) == (0.666666667, 0.666666667) and (q["b"].slot_recall, q["b"].unwarranted, q["b"].direct_right) == (None, 1, None)
    assert sorted(tuple(r) for r in A.call_errors(s).collect()) == [("a", k, 1, 0.25) for k in ("arguments", "method", "omitted", "right")]
    assert tuple(A.refusals(s).first()) == (3, 0.666666667, 0.5, 1, 1.0)
    assert tuple(A.refusals(s.filter("false")).first()) == (0, None, None, 0, None)
    ci = {(r.app, r.ratio): (r.point, r.lo, r.hi) for r in A.quality_ci(s, replicates=300).collect()}
    assert ci["a", "quality"][0] == 0.4 and ci["a", "quality_of_calls"][0] == 0.25 and ci["a", "intent_accuracy"][0] == 0.8
    assert ci["a", "quality"][1] == 0.0 and ci["a", "quality"][2] == 1.0 and ci["b", "direct_right"] == (None, None, None)


def test_saturation_and_growth(spark):
    rate = lambda rows: spark.createDataFrame(rows, "method string, level double, rate double")
    levels = rate([("m0", x, 0.2) for x in (0.0, 0.5, 1.0)] + [("m1", 0.0, 0.2), ("m1", 0.5, 0.3), ("m1", 1.0, 0.35), ("h", 0.0, 0.3), ("h", 0.5, 0.3), ("h", 1.0, 0.4)])
    assert {r.method: r["index"] for r in M.saturation(levels, "m0").collect()} == {"m1": 0.5, "h": None}
    grown = M.growth(rate([("m0", 1.0, 0.0), ("m0", 2.0, 0.1), ("m0", 5.0, 0.4), ("m1", 1.0, 0.1), ("m1", 2.0, 0.15), ("m1", 5.0, 0.6)]), "m0")
    assert {(r.method, r.level): (r.relative, r.points) for r in grown.collect() if r.method == "m1"} == {("m1", 1.0): (None, None), ("m1", 2.0): (0.5, 5.0), ("m1", 5.0): (0.5, 15.0)}

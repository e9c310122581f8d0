"""Annotated dialogues: turns whose frames carry a service's actions, slot spans, state and call.

A service's own names are read through maps (slot_of, intent_of) to concepts that services share; a name without a concept stands
for itself. Only the first frame of a turn is looked at, as in dialogues of one service. All but turns(), methods() and the
summaries are expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics as M

#: Acts of a user who declines or agrees, and of a system that proposes a value.
DECLINES = ("NEGATE", "NEGATE_INTENT")
AGREES = ("AFFIRM", "SELECT", "AFFIRM_INTENT")
PROPOSES = ("OFFER", "CONFIRM")
FROM_SYSTEM = "FROM_SYSTEM"


def length(x: Column) -> Column:
    """Size of an array or map, 0 for null."""
    return F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))


def latest(pairs: Column) -> Column:
    """A map of an array of (k, v) in which the last value of a key counts; pairs without a key are left out."""
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    seen = F.zip_with(placed, F.slice(placed, F.lit(2), F.size(placed)), lambda x, y: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["k"].eqNullSafe(y["k"]).alias("again")))
    return F.map_from_entries(F.transform(F.filter(seen, lambda p: p["k"].isNotNull() & ~p["again"]), lambda p: F.struct(p["k"], p["v"])))


def concept(name: Column, of: Column) -> Column:
    """The concept of a service's name, or the name itself."""
    return F.coalesce(F.element_at(of, name), name)


def renamed(slots: Column, of: Column) -> Column:
    """A map by slot as one by concept; of several slots of one concept the last counts."""
    return latest(F.transform(F.map_entries(slots), lambda e: F.struct(concept(e["key"], of).alias("k"), e["value"].alias("v"))))


def names(mapping: DataFrame) -> DataFrame:
    """(service, slot_of, intent_of) of a mapping (kind, concept, service, name); of several concepts of a name the least."""
    one = mapping.filter("name is not null").groupBy("service", "kind", "name").agg(F.min("concept").alias("concept"))
    of = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "concept"))))
    return one.groupBy("service").agg(of("slots").alias("slot_of"), of("intents").alias("intent_of"))


def turns(dialogues: DataFrame, mapping: DataFrame) -> DataFrame:
    """User turns of dialogues (key, services, turns) with what was before and after them.

    Returns key, services, turn, utterance, frame, system (the last system frame, null at the start), before (the state after the
    last user turn, null at the start), call (the service call of the next turn, if it is the system's), slot_of and intent_of.
    """
    rows = dialogues.select("key", "services", F.posexplode("turns").alias("turn", "t"))
    rows = rows.select("key", "services", "turn", "t.speaker", "t.utterance", F.get("t.frames", F.lit(0)).alias("frame"))
    order = Window.partitionBy("key").orderBy("turn")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    by_user, by_system = F.col("speaker") == "USER", F.col("speaker") == "SYSTEM"
    rows = rows.withColumns({
        "system": F.last(F.when(by_system, F.struct("frame")), ignorenulls=True).over(earlier)["frame"],
        "before": F.last(F.when(by_user, F.struct(F.col("frame.state").alias("state"))), ignorenulls=True).over(earlier)["state"],
        "call": F.lead(F.when(by_system, F.col("frame.service_call"))).over(order),
    })
    return rows.filter(by_user).drop("speaker").join(names(mapping).withColumnRenamed("service", "_service"), F.col("frame.service") == F.col("_service"), "left").drop("_service")


def single_service(services: Column) -> Column:
    """Dialogues with one service."""
    return F.size(services) == 1


def among_others(services: Column, served: list[str]) -> Column:
    """Dialogues of several services of which one is served."""
    return (F.size(services) > 1) & F.arrays_overlap(services, F.array(*map(F.lit, served)))


def out_of_catalogue(services: Column, known: list[str]) -> Column:
    """Dialogues of no known service."""
    return ~F.arrays_overlap(services, F.array(*map(F.lit, known)))


def asks_task(frame: Column) -> Column:
    """Whether a user turn says what it wants done."""
    return F.coalesce(F.exists(frame["actions"], lambda a: a["act"] == "INFORM_INTENT"), F.lit(False))


def methods(schemas: DataFrame, mapping: DataFrame) -> DataFrame:
    """(service, intent, method, required, optional): what realises an intent in a service, its slots as concepts."""
    each = schemas.select(F.col("service_name").alias("service"), F.explode("intents").alias("i")).join(names(mapping), "service")
    as_concepts = lambda slots: F.transform(slots, lambda s: concept(s, F.col("slot_of")))
    found = each.select("service", F.element_at("intent_of", F.col("i.name")).alias("intent"), F.col("i.name").alias("method"), as_concepts(F.col("i.required_slots")).alias("required"), as_concepts(F.map_keys("i.optional_slots")).alias("optional"))
    return found.filter("intent is not null")


def system_acts(frame: Column, of: Column) -> Column:
    """The system's acts as sorted distinct ACT or ACT:concept; START before its first turn, NOACT for one without acts."""
    said = F.transform(frame["actions"], lambda a: F.when(F.coalesce(a["slot"], F.lit("")) == "", a["act"]).otherwise(F.concat(a["act"], F.lit(":"), concept(a["slot"], of))))
    found = F.array_sort(F.array_distinct(said))
    return F.when(frame.isNull(), F.array(F.lit("START"))).when(length(found) > 0, found).otherwise(F.array(F.lit("NOACT")))


def requested(acts: Column) -> Column:
    """The concepts that the system's acts ask for."""
    return F.transform(F.filter(acts, lambda a: a.startswith("REQUEST:")), lambda a: F.substr(a, F.lit(len("REQUEST:") + 1)))


def offered(frame: Column, of: Column) -> Column:
    """concept -> the first value that the system proposed; the last proposal of a concept counts."""
    made = F.filter(frame["actions"], lambda a: a["act"].isin(*PROPOSES) & (length(a["values"]) > 0))
    return F.coalesce(latest(F.transform(made, lambda a: F.struct(concept(a["slot"], of).alias("k"), F.get(a["values"], F.lit(0)).alias("v")))), _empty("string"))


def _empty(kind: str) -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))


def values_by_slot(frame: Column) -> Column:
    """A service's slot -> the values in the frame's actions; the last action of a slot counts."""
    return F.coalesce(latest(F.transform(frame["actions"], lambda a: F.struct(a["slot"].alias("k"), F.coalesce(a["values"], F.array().cast("array<string>")).alias("v")))), _empty("array<string>"))


def user_act(frame: Column) -> Column:
    """negate, else accept, else other."""
    acts = F.transform(frame["actions"], lambda a: a["act"])
    has = lambda kinds: F.coalesce(F.arrays_overlap(acts, F.array(*map(F.lit, kinds))), F.lit(False))
    return F.when(has(DECLINES), "negate").when(has(AGREES), "accept").otherwise("other")


def turn_kind(changed: Column, categorical: Column) -> Column:
    """entity if a changed slot is free text, categorical if all are from lists, no_value if none changed. Unknown slots are free text."""
    free = F.exists(F.map_keys(changed), lambda s: ~F.coalesce(F.element_at(categorical, s), F.lit(False)))
    return F.when(length(changed) == 0, "no_value").when(free, "entity").otherwise("categorical")


def interpretation(intent: Column, changed: Column, asked: Column, slot_of: Column, intent_of: Column, said_before: Column | None = None) -> Column:
    """What a turn means: (intent, slots, requested) in concepts, sorted. With said_before (slot -> values of the system's last
    turn) a value that comes from there is FROM_SYSTEM, so that the same reply to other offers means the same."""

    def value(e: Column) -> Column:
        if said_before is None:
            return e["value"]
        taken = F.coalesce(F.arrays_overlap(e["value"], F.element_at(said_before, e["key"])), F.lit(False))
        return F.when(taken, F.array(F.lit(FROM_SYSTEM))).otherwise(e["value"])

    slots = F.transform(F.map_entries(changed), lambda e: F.struct(concept(e["key"], slot_of).alias("slot"), value(e).alias("values")))
    return F.struct(concept(intent, intent_of).alias("intent"), F.array_sort(slots).alias("slots"), F.array_sort(F.transform(asked, lambda s: concept(s, slot_of))).alias("requested"))


def concept_rule(name: Column, description: Column, categorical: Column) -> Column:
    """The common concept that a foreign slot's name or description gives away; null for slots from lists and all others."""
    ends = lambda w: (name == w) | name.endswith(f"_{w}")
    return F.when(categorical, F.lit(None).cast("string")).when(F.lower(description).rlike(r"\bcity\b"), "place.city").when(ends("date"), "event.date").when(ends("time"), "event.time")


def canonical(turns: Column) -> Column:
    """Lower-case value -> lower-case canonical value, from all actions of a dialogue's turns; the last one counts."""
    actions = F.flatten(F.transform(F.flatten(F.transform(turns, lambda t: t["frames"])), lambda f: f["actions"]))
    pairs = F.flatten(F.transform(actions, lambda a: F.zip_with(a["values"], a["canonical_values"], lambda v, c: F.struct(F.lower(v).alias("k"), F.lower(c).alias("v")))))
    return F.coalesce(latest(F.filter(pairs, lambda p: p["v"].isNotNull())), _empty("string"))


def equal_value(said: Column, golds: Column, canon: Column) -> Column:
    """Whether a value is one of the golds, whatever the case, itself or by its canonical form."""
    p, low = F.lower(said), F.transform(golds, F.lower)
    return F.coalesce(F.array_contains(low, p) | F.exists(low, lambda g: concept(g, canon) == concept(p, canon)), F.lit(False))


def same_set(x: Column, y: Column) -> Column:
    """Equal whatever the order and repeats."""
    return F.array_sort(F.array_distinct(x)).eqNullSafe(F.array_sort(F.array_distinct(y)))


def same_list(x: Column, y: Column) -> Column:
    """Equal in order too."""
    return x.eqNullSafe(y)


def decision_features(intent: Column, act: Column, required: Column, optional: Column, state: Column, new: Column, intent_changed: Column, acts: Column) -> Column:
    """name -> value for the decision to call. state and new are arrays of concepts, required and optional those of the intent's
    method, null where there is none; indicators that are 0 are left out."""
    supported = required.isNotNull()
    complete = supported & F.coalesce(F.size(F.array_except(required, state)) == 0, F.lit(False))
    inside = supported & F.coalesce(F.arrays_overlap(new, F.concat(required, optional)), F.lit(False))
    opens = lambda kind: F.exists(acts, lambda a: a.startswith(kind))
    marks = [
        (F.lit("bias"), F.lit(True)), (F.concat(F.lit("intent="), intent), F.lit(True)), (F.concat(F.lit("act="), act), F.lit(True)),
        (F.lit("supported"), supported), (F.lit("req_complete"), complete), (F.lit("any_new"), F.size(new) > 0), (F.lit("intent_changed"), intent_changed),
        (F.lit("new_in_method"), inside), (F.concat(F.lit("req_complete&"), intent), complete),
        (F.concat(F.lit("act="), act, F.lit("&prevCONFIRM")), opens("CONFIRM")), (F.concat(F.lit("act="), act, F.lit("&prevOFFER_INTENT")), opens("OFFER_INTENT")),
    ]
    own = F.array_compact(F.array(*(F.when(on, name) for name, on in marks)))
    each = lambda kind, of: F.transform(of, lambda x: F.concat(F.lit(kind), x))
    heads = F.transform(acts, lambda a: F.substring_index(a, ":", 1))
    found = F.array_distinct(F.concat(own, each("new=", new), each("pa=", acts), each("pact=", heads)))
    ones = F.transform(found, lambda n: F.struct(n.alias("k"), F.lit(1).alias("v")))
    return F.map_from_entries(F.concat(ones, F.array(F.struct(F.lit("n_new").alias("k"), F.size(new).alias("v")))))


def scored(rows: DataFrame) -> DataFrame:
    """Each turn's outcome against its annotation.

    rows have intent, state (concept -> values), call (method, parameters: concept -> value) and canon as annotated, and said_intent,
    said (concept -> value) and said_call as predicted; calls are null where there is none. Adds intent_ok, state_ok, slot_tp,
    slot_said, slot_gold, call_gold, call_said, method_ok and args_ok (null unless both call) and right.
    """
    hit = lambda said, gold: F.size(F.filter(F.map_entries(gold), lambda e: equal_value(F.element_at(said, e["key"]), e["value"], F.col("canon"))))
    gold_args = F.transform_values("call.parameters", lambda k, v: F.array(v))
    both = F.col("call").isNotNull() & F.col("said_call").isNotNull()
    rows = rows.withColumns({
        "intent_ok": F.col("intent").eqNullSafe(F.col("said_intent")), "slot_tp": F.coalesce(hit(F.col("said"), F.col("state")), F.lit(0)),
        "slot_said": length(F.col("said")), "slot_gold": length(F.col("state")), "call_gold": F.col("call").isNotNull(), "call_said": F.col("said_call").isNotNull(),
        "method_ok": F.when(both, F.col("call.method").eqNullSafe(F.col("said_call.method"))),
        "args_ok": F.when(both, (length(F.col("call.parameters")) == length(F.col("said_call.parameters"))) & (F.coalesce(hit(F.col("said_call.parameters"), gold_args), F.lit(0)) == length(F.col("call.parameters")))),
    })
    none = ~F.col("call_gold") & ~F.col("call_said")
    return rows.withColumns({"state_ok": (F.col("slot_said") == F.col("slot_gold")) & (F.col("slot_tp") == F.col("slot_gold")), "right": none | F.coalesce(F.col("method_ok") & F.col("args_ok"), F.lit(False))})


def quality(turns: DataFrame, by: str = "app") -> DataFrame:
    """Shares and counts over scored turns, which also have direct (answered without a further model) and ms. Undefined ratios are
    null; ms_p95 is interpolated."""
    share = lambda c, on=None: F.round(F.avg((c if on is None else F.when(on, c)).cast("double")), 9)
    both, full = F.col("call_gold") & F.col("call_said"), F.coalesce(F.col("method_ok") & F.col("args_ok"), F.lit(False))
    ratio = lambda x, y: F.round(F.try_divide(F.sum(x), F.sum(y)), 9)
    return turns.groupBy(by).agg(
        F.count("*").alias("turns"), share(F.col("intent_ok")).alias("intent_accuracy"), share(F.col("state_ok")).alias("full_state"),
        ratio("slot_tp", "slot_said").alias("slot_precision"), ratio("slot_tp", "slot_gold").alias("slot_recall"),
        F.count_if("call_gold").alias("calls_gold"), F.count_if("call_said").alias("calls_said"),
        F.count_if(F.col("call_said") & ~F.col("call_gold")).alias("unwarranted"), F.count_if(F.col("call_gold") & ~F.col("call_said")).alias("omitted"),
        share(F.col("method_ok"), both).alias("method_ok"), share(F.col("args_ok"), both).alias("args_ok"), share(F.col("right")).alias("quality"),
        share(F.col("direct")).alias("direct"), share(full & F.col("call_gold"), F.col("direct")).alias("direct_right"),
        F.round(F.percentile("ms", F.lit(0.5)), 9).alias("ms_median"), F.round(F.percentile("ms", F.lit(0.95)), 9).alias("ms_p95"), F.round(F.avg("ms"), 9).alias("ms_mean"),
    )


def call_errors(turns: DataFrame, by: str = "app") -> DataFrame:
    """(by, outcome, n, share) over scored turns with an annotated call: omitted, method, arguments or right."""
    outcome = F.when(~F.col("call_said"), "omitted").when(~F.col("method_ok"), "method").when(~F.col("args_ok"), "arguments").otherwise("right")
    n = turns.filter("call_gold").groupBy(by, outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 9))


def refusals(turns: DataFrame) -> DataFrame:
    """One row of rates over turns (pool, support): 'outside' requests that are refused, 'served' ones that are refused by mistake, and
    'probe' requests, known but not supported, that are told so. A pool without turns gives null."""
    rate = lambda pool, said: F.round(F.avg(F.when(F.col("pool") == pool, (F.col("support") == said).cast("double"))), 9)
    return turns.agg(F.count_if(F.col("pool") == "outside").alias("requests"), rate("outside", "out_of_catalog").alias("refused"), rate("served", "out_of_catalog").alias("wrongly_refused"), F.count_if(F.col("pool") == "probe").alias("probes"), rate("probe", "known_unsupported").alias("flagged"))


def quality_ci(turns: DataFrame, by: str = "app", replicates: int = 2000) -> DataFrame:
    """(by, ratio, point, lo, hi): five ratios of sums over scored turns, resampled by dialogue (key), so that turns of one
    dialogue stay together. A dialogue's sums are made first; all ratios see the same resample."""
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    direct = F.col("direct")
    sums = turns.groupBy(by, "key").agg(
        F.count("*").alias("n"), one(F.col("right")).alias("q"), one(F.col("call_gold")).alias("calls"), one(F.col("call_gold") & F.col("right")).alias("calls_right"),
        one(direct).alias("d"), one(direct & F.col("call_gold") & F.col("right")).alias("direct_right"), one(F.col("intent_ok")).alias("i"),
    )
    pairs = {"quality": ("q", "n"), "quality_of_calls": ("calls_right", "calls"), "direct": ("d", "n"), "direct_right": ("direct_right", "d"), "intent_accuracy": ("i", "n")}
    each = sums.select(by, "key", F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in pairs.items()))).alias("r")).select(by, "key", "r.*")
    return M.bootstrap(each, F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum(F.col("y") * F.col("w"))), replicates, (by, "ratio"), "key")

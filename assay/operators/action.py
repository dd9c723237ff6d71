"""Actions from rules over states, and the invariants that let them through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(action: Column) -> Column:
    """The identity of an action: its JSON, nulls kept."""
    return F.to_json(action, {"ignoreNullFields": "false"})


def generate(states: DataFrame, id: str, policy: list[tuple[str, Column, Column]]) -> DataFrame:
    """(state, action_key, action, rules) of rules (name, condition, array of structs): equal actions once, with their rules.

    A condition or action that is null (try_ functions make errors null) is recorded as an action _ERROR with a null
    action. Results don't depend on the order of the rules except for the list of rules, which follows it."""
    frames = []
    for k, (name, cond, actions) in enumerate(policy):
        base = states.select(F.col(id).alias("state"), cond.alias("fires"), actions.alias("actions"), F.lit(name).alias("rule"), F.lit(k).alias("k"))
        bad = F.col("fires").isNull() | (F.col("fires") & F.col("actions").isNull())
        fired = base.filter("fires and actions is not null").select("state", "rule", "k", F.explode("actions").alias("action"))
        kind = fired.schema["action"].dataType
        broken = base.filter(bad).select("state", "rule", "k", F.lit(None).cast(kind).alias("action"))
        frames.append(fired.unionByName(broken))
    rows = reduce(DataFrame.unionByName, frames).withColumn("action_key", F.coalesce(canonical(F.col("action")), F.lit("_ERROR")))
    grouped = rows.groupBy("state", "action_key").agg(F.first("action").alias("action"), F.array_sort(F.collect_set(F.struct("k", "rule"))).alias("r"))
    return grouped.select("state", "action_key", "action", F.col("r.rule").alias("rules"))


def no_duplicate() -> tuple[str, Column, str]:
    n, d = F.count("action"), F.count_distinct(F.when(F.col("action").isNotNull(), F.col("action_key")))
    return "no_duplicate", F.when(n != d, "an action occurs twice"), "error"


def budget(field: str, limit: Column) -> tuple[str, Column, str]:
    """The sum may reach the limit; an action with a null cost violates."""
    cost = F.col(f"action.{field}")
    broken = F.count_if(F.col("action").isNotNull() & cost.isNull()) > 0
    return "budget", F.when(broken, "a cost is null").when(F.coalesce(F.sum(cost), F.lit(0.0)) > F.max(limit), "over budget"), "error"


def required_fields(fields: list[str]) -> tuple[str, Column, str]:
    lacks = reduce(lambda a, b: a | b, (F.col(f"action.{f}").isNull() | (F.col(f"action.{f}").cast("string") == "") for f in fields))
    return "required_fields", F.when(F.count_if(F.col("action").isNotNull() & lacks) > 0, "a field is missing"), "error"


def not_contradict(field: str, pairs: list[tuple[str, str]]) -> tuple[str, Column, str]:
    have = lambda x: F.count_if(F.col(f"action.{field}") == x) > 0
    return "not_contradict", F.when(reduce(lambda a, b: a | b, (have(a) & have(b) for a, b in pairs)), "contradicting actions"), "error"


def expected_count(expected: Column, severity: str = "error") -> tuple[str, Column, str]:
    return "expected_count", F.when(F.count("action") != F.max(expected), "another number of actions"), severity


def check(actions: DataFrame, states: DataFrame, id: str, invariants: list[tuple[str, Column, str]]) -> DataFrame:
    """(state, invariant, severity, detail) of each violation; states without actions are checked too.

    Invariants are aggregates over a state's actions and its own columns that give a text where they are violated."""
    own = states.withColumnRenamed(id, "state")
    joined = own.join(actions, "state", "left")
    found = joined.groupBy("state").agg(*(v.alias(f"v{i}") for i, (_, v, _) in enumerate(invariants)))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("invariant"), F.lit(s).alias("severity"), F.col(f"v{i}").alias("detail")) for i, (n, _, s) in enumerate(invariants))))
    return found.select("state", each.alias("e")).select("state", "e.*").filter("detail is not null")


def run(actions: DataFrame, violations: DataFrame) -> DataFrame:
    """The generated actions with `committed`: those of states without a violation of severity error."""
    bad = violations.filter("severity = 'error'").select("state").distinct().withColumn("blocked", F.lit(True))
    return actions.join(bad, "state", "left").withColumn("committed", F.col("blocked").isNull() & F.col("action").isNotNull()).drop("blocked")

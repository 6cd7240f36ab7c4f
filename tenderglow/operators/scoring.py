"""Commercial score and priority, as plain columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderglow import rules as R
from tenderglow.functions import text as T
from tenderglow.functions import values as V


def _first_band(bands: Sequence[tuple[Column, int]], otherwise: int) -> Column:
    out: Column | None = None
    for condition, points in bands:
        out = F.when(condition, points) if out is None else out.when(condition, points)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def amount_points(amount: Column, rules: R.ScoreRules = R.ScoreRules()) -> Column:
    return _first_band([(amount > F.lit(b), p) for b, p in rules.amount_bands], rules.amount_floor)


def pre_tender_strength(
    state: Column, description: Column, rules: R.ScoreRules = R.ScoreRules()
) -> Column:
    """``forte``/``debole`` for pre-tender notices, else null."""
    strong = T.contains_any(F.lower(description), rules.strong_words)
    return F.when(state == R.PRE_TENDER, F.when(strong, "forte").otherwise("debole"))


def state_points(state: Column, strength: Column, rules: R.ScoreRules = R.ScoreRules()) -> Column:
    return (
        F.when(state == R.PUBLISHED, rules.published)
        .when(state.startswith("RETTIFICA"), rules.amended)
        .when(
            state == R.PRE_TENDER,
            F.when(strength == "forte", rules.pre_tender_strong).otherwise(rules.pre_tender_weak),
        )
        .when(state.startswith("ESITO"), rules.outcome)
        .otherwise(0)
    )


def deadline_points(days: Column, rules: R.ScoreRules = R.ScoreRules()) -> Column:
    """Nearer is more; a past deadline counts as nearest, none as nothing."""
    return _first_band([(days <= F.lit(d), p) for d, p in rules.deadline_bands], 0)


def bonus_points(ppp_flag: Column, tags: Column, rules: R.ScoreRules = R.ScoreRules()) -> Column:
    """Points for public-private partnership, recovery funds, EU threshold and frameworks."""
    is_ppp = F.lower(T.strip(F.coalesce(ppp_flag, F.lit("")))) == "yes"
    framework = F.exists(tags, lambda t: T.contains_any(F.lower(t), rules.framework_words))
    return (
        F.when(is_ppp, rules.ppp).otherwise(0)
        + F.when(F.array_contains(tags, "PNRR"), rules.pnrr).otherwise(0)
        + F.when(F.array_contains(tags, R.EU_THRESHOLD_TAG), rules.eu_threshold).otherwise(0)
        + F.when(framework, rules.framework).otherwise(0)
    )


def priority(
    score: Column, amount: Column, state: Column, days: Column, rules: R.ScoreRules = R.ScoreRules()
) -> Column:
    top = (
        (score >= rules.p1_score)
        | ((amount > F.lit(rules.p1_amount)) & (state == R.PUBLISHED))
        | days.between(0, rules.p1_days)
    )
    return (
        F.when(top, "P1")
        .when(score >= rules.p2_score, "P2")
        .when(score >= rules.p3_score, "P3")
        .otherwise("P4")
    )


def score(records: DataFrame, now: datetime, rules: R.ScoreRules = R.ScoreRules()) -> DataFrame:
    """Add ``score_commerciale`` and ``priorita_commerciale`` to every record, master or not."""
    amount, state = F.col("importo").cast("double"), F.col("stato_procedurale")
    days = V.days_until(F.col("scadenza"), now)
    points = (
        amount_points(amount, rules)
        + state_points(state, pre_tender_strength(state, F.col("descrizione"), rules), rules)
        + deadline_points(days, rules)
        + bonus_points(F.col("flag_ppp_doppio_oggetto"), T.tag_list(F.col("tag_tecnico")), rules)
    )
    return records.withColumn("score_commerciale", points.cast("int")).withColumn(
        "priorita_commerciale",
        priority(F.col("score_commerciale"), amount, state, days, rules),
    )

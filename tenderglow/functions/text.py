"""Text columns: whitespace, phrase scores, tags, flags, identifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderglow import rules as R

# Unicode-aware and case-insensitive, as the source texts are Italian.
ANY_CASE = "(?iuU)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once per row.

    Spark repeats an expression wherever it is used, and pushing a filter down multiplies that;
    a lambda over a one-element array names the value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Cut every kind of whitespace from both ends (``trim`` cuts blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def filled_stripped(c: Column) -> Column:
    return filled(strip(c))


def clean_text(c: Column) -> Column:
    """Whitespace collapsed to single blanks; null when nothing is left."""
    return filled(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def join_filled(separator: str, *parts: Column) -> Column:
    """Join the parts that hold text; an empty text when none does."""
    return F.concat_ws(separator, *[filled(p) for p in parts])


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive regex search; a null text matches nothing."""
    return F.coalesce(c.rlike(ANY_CASE + pattern), F.lit(False))


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """True when an already lowercased text holds one of the words."""
    hits = [lowered.contains(w) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def yes_no(condition: Column) -> Column:
    return F.when(condition, R.YES).otherwise(R.NO)


def has_code(c: Column, codes: Sequence[str] = R.SCOPE_CODES) -> Column:
    """True when a whole 8-digit code (with or without check digit) is in the text."""
    return F.coalesce(c.rlike(r"(?U)\b(?:" + "|".join(codes) + r")(?:-\d)?\b"), F.lit(False))


def scope_points(c: Column, scope: R.ScopeRules = R.ScopeRules()) -> Column:
    """Only the number: phrase hits weighted, each phrase counted once, plus the code bonus."""

    def points(low: Column) -> Column:
        terms = [F.when(low.contains(p), scope.include_points).otherwise(0) for p in scope.include]
        terms += [F.when(low.contains(p), scope.exclude_points).otherwise(0) for p in scope.exclude]
        return reduce(lambda a, b: a + b, terms, F.lit(0))

    phrases = F.coalesce(bound(F.lower(c), points), F.lit(0))
    if not scope.codes:
        return phrases
    return phrases + F.when(has_code(c, scope.codes), scope.code_points).otherwise(0)


def in_scope(c: Column, scope: R.ScopeRules = R.ScopeRules()) -> Column:
    return scope_points(c, scope) >= F.lit(scope.threshold)


def scope_detail(c: Column, scope: R.ScopeRules = R.ScopeRules()) -> Column:
    """Struct of score, the phrases hit on either side, code match and verdict."""
    low = F.lower(c)

    def hits(phrases: Sequence[str]) -> Column:
        if not phrases:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*[F.when(low.contains(p), p) for p in phrases]))

    code = has_code(c, scope.codes) if scope.codes else F.lit(False)
    score = scope_points(c, scope)
    return F.struct(
        score.alias("score"),
        hits(scope.include).alias("include_hits"),
        hits(scope.exclude).alias("exclude_hits"),
        code.alias("code_match"),
        (score >= scope.threshold).alias("in_scope"),
    )


def tags(c: Column, amount: Column | None = None, tag_rules: R.TagRules = R.TagRules()) -> Column:
    """Technical tags in rule order, the size tag last."""
    labels = [F.when(matches(c, p), label) for label, p in tag_rules.patterns]
    if amount is not None:
        labels.append(F.when(amount > F.lit(tag_rules.threshold), tag_rules.threshold_tag))
    return F.array_compact(F.array(*labels))


def tag_text(tag_array: Column) -> Column:
    """Stored form: comma-joined, null when there is none."""
    return filled(F.array_join(tag_array, ","))


def tag_list(text: Column) -> Column:
    """Stored form back to an array; blanks around labels are cut."""
    return F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda x: x != F.lit("")
    )


def flags(c: Column, patterns: Sequence[tuple[str, str]] = R.FLAG_PATTERNS) -> dict[str, Column]:
    """One Yes/No column per flag rule."""
    return {name: yes_no(matches(c, p)) for name, p in patterns}


def valid_cig(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).rlike(R.CIG_PATTERN), F.lit(False))


def cup_match(c: Column) -> Column:
    return F.coalesce(c.rlike(R.CUP_PATTERN), F.lit(False))


def state(text: Column, act_type: Column, state_rules: R.StateRules = R.StateRules()) -> Column:
    """Procedural state of a notice: act type first, then outcome, amendment, pre-tender."""
    act = filled(act_type)
    return (
        F.when(act.isNotNull() & (act != F.lit(state_rules.news_act)), R.PRE_TENDER)
        .when(matches(text, state_rules.outcome), R.OUTCOME)
        .when(matches(text, state_rules.amended), R.AMENDED)
        .when(matches(text, state_rules.pre_tender), R.PRE_TENDER)
        .otherwise(R.PUBLISHED)
    )


def reliability(rank: Column) -> Column:
    return F.when(rank <= 3, "Alta").when(rank <= 5, "Media").otherwise("Bassa")


# ---- alert keys -----------------------------------------------------------------------------------


def alert_text(key: Column, text: Column) -> Column:
    return F.concat(F.lit("[key:"), key, F.lit("] "), text)


def alert_key(description: Column) -> Column:
    """The key stored in front of an alert text; null without one."""
    return filled(F.regexp_extract(description, r"^\[key:([^\]]+)\]", 1))

"""Validation of semi-structured answers (F13) as VARIANT: a rule gives the errors of a value, each with its path."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.config import CONNECTION_KINDS

#: Kinds and roles of extracted entities (fixed values).
ENTITY_KINDS = ("PERSON", "ORG", "PLACE", "PRODUCT", "EVENT", "BRAND", "WORD", "TIME", "NUMBER", "OTHER")
ENTITY_ROLES = ("SUBJECT", "OBJECT", "CONTEXT")

#: (value as a variant, its path) to an array of texts, empty if the value is good. A missing value is null, a JSON null has the type VOID.
Rule = Callable[[Column, Column], Column]


def _errors(*found: tuple[Column, str], path: Column) -> Column:
    """The first that holds, as an array of one text."""
    out = F.expr("cast(array() as array<string>)")
    for condition, text in reversed(found):
        out = F.when(condition, F.array(F.concat(path, F.lit(f": {text}")))).otherwise(out)
    return out


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _units(text: Column) -> Column:
    """Length in UTF-16 units, by which the rules count."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def string(least: int = 0, most: int | None = None) -> Rule:
    def rule(v: Column, path: Column) -> Column:
        found = [(_type(v) != "STRING", "not a string"), (_units(_text(v)) < least, "too short")]
        return _errors(*found, *([(_units(_text(v)) > most, "too long")] if most is not None else []), path=path)

    return rule


def enum(*values: str) -> Rule:
    return lambda v, path: _errors((_type(v) != "STRING", "not a string"), (~_text(v).isin(*values), "not one of the values"), path=path)


def boolean() -> Rule:
    return lambda v, path: _errors((_type(v) != "BOOLEAN", "not a boolean"), path=path)


def number(low: float | None = None, high: float | None = None, whole: bool = False) -> Rule:
    def rule(v: Column, path: Column) -> Column:
        x, kind = F.try_variant_get(v, "$", "double"), _type(v)
        found = [(~(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")), "not a number")]
        found += [(x != F.floor(x), "not a whole number")] if whole else []
        found += [(x < low, "too small")] if low is not None else []
        return _errors(*found, *([(x > high, "too large")] if high is not None else []), path=path)

    return rule


def optional(of: Rule, null: bool = False) -> Rule:
    """A value that may be missing, and with `null` may be a JSON null as well."""
    return lambda v, path: F.when(_type(v).isin("MISSING", *(["VOID"] if null else [])), F.expr("cast(array() as array<string>)")).otherwise(of(v, path))


def array(of: Rule, least: int = 0, most: int | None = None) -> Rule:
    """Errors of the length come before those of the elements, which are all given."""

    def rule(v: Column, path: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.flatten(F.transform(items, lambda x, i: of(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        size = [(F.size(items) < least, "too few elements")] + ([(F.size(items) > most, "too many elements")] if most is not None else [])
        return F.when(~_type(v).startswith("ARRAY"), F.array(F.concat(path, F.lit(": not an array")))).otherwise(F.concat(_errors(*size, path=path), each))

    return rule


def record(**fields: Rule) -> Rule:
    """An object with these fields; others are let through."""

    def rule(v: Column, path: Column) -> Column:
        each = [of(F.try_variant_get(v, f"$.{name}", "variant"), F.concat(path, F.lit(f".{name}"))) for name, of in fields.items()]
        return F.when(~_type(v).startswith("OBJECT"), F.array(F.concat(path, F.lit(": not an object")))).otherwise(F.concat(*each))

    return rule


SUMMARY = record(sentences=array(string(1), 3, 3))
ENTITIES = record(entities=array(record(
    surface=string(1), normalized=string(1), kind=enum(*ENTITY_KINDS), subtype=optional(string()), importance=number(0, 1), in_headline=boolean(), role=enum(*ENTITY_ROLES), aliases=optional(array(string())), parent=optional(string()),
), most=20))
JUDGEMENTS = record(judgements=array(record(
    company_id=number(whole=True), verdict=enum("ACCEPT", "REJECT"), connection_type=enum(*CONNECTION_KINDS), business_relevance=number(0, 100, True), meme=number(0, 100, True), confidence=number(0, 100, True),
    explanation=string(0, 60), caution=optional(string(0, 80), null=True), used_path_steps=optional(array(number(whole=True))),
)))
COUNTER_CHECK = record(refuted=boolean(), reason=string(0, 100), adjusted_relevance=number(0, 100, True))
STAGES: dict[str, Rule] = {"SUMMARY": SUMMARY, "ENTITY": ENTITIES, "MATCH": JUDGEMENTS, "COUNTER": COUNTER_CHECK}


class Split(NamedTuple):
    ok: DataFrame
    invalid: DataFrame


def checked(answers: DataFrame, stages: dict[str, Rule] | None = None) -> DataFrame:
    """answers (stage, json, ...) with answer (variant, null if json isn't JSON), errors (array of path and fault) and status: OK, or INVALID_JSON
    for whatever isn't JSON or breaks a rule of its stage; an unknown stage is an error of its own. One pass, inside the JVM."""
    rules = STAGES if stages is None else stages
    v = answers.withColumn("answer", F.try_parse_json("json"))
    errors = F.array(F.concat(F.lit("$: unknown stage "), F.coalesce("stage", F.lit("null"))))
    for stage, rule in rules.items():
        errors = F.when(F.col("stage") == stage, rule(F.col("answer"), F.lit("$"))).otherwise(errors)
    v = v.withColumn("errors", F.when(F.col("answer").isNull(), F.array(F.lit("$: not JSON"))).otherwise(errors))
    return v.withColumn("status", F.when(F.size("errors") == 0, "OK").otherwise("INVALID_JSON"))


def split(answers: DataFrame, stages: dict[str, Rule] | None = None) -> Split:
    c = checked(answers, stages)
    return Split(c.where("status = 'OK'"), c.where("status <> 'OK'"))

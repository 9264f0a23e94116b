"""The closed set of cleaning steps an attribute may go through, compiled to column expressions."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.rules import SIMPLE_TEXT
from sediment.types import normalize_sql_type, parse_sql_type

# The date and timestamp layouts a parse step may use (Spark datetime patterns).
DATE_FORMATS = (
    "yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "MMddyyyy", "ddMMyyyy",
)
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMddHHmmss",
    "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
)

_STRING = T.StringType()


@dataclass(frozen=True)
class Trim:
    pass


@dataclass(frozen=True)
class Upper:
    pass


@dataclass(frozen=True)
class Lower:
    pass


@dataclass(frozen=True)
class NullIf:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Cast:
    type: str


@dataclass(frozen=True)
class ParseDate:
    format: str


@dataclass(frozen=True)
class ParseTimestamp:
    format: str


@dataclass(frozen=True)
class Default:
    value: str


Step = Trim | Upper | Lower | NullIf | Cast | ParseDate | ParseTimestamp | Default

_KINDS = {
    "trim": Trim, "upper": Upper, "lower": Lower, "null_if": NullIf, "cast": Cast,
    "parse_date": ParseDate, "parse_timestamp": ParseTimestamp, "default": Default,
}


def step_from_dict(data: dict) -> Step:
    """{"kind": "null_if", "values": [...]} -> NullIf(...); unknown kinds and fields are errors."""
    fields = dict(data)
    kind = fields.pop("kind", None)
    if kind not in _KINDS:
        raise ValueError(f"unknown step {kind!r}")
    if "values" in fields:
        fields["values"] = tuple(fields["values"])
    try:
        return _KINDS[kind](**fields)
    except TypeError as error:
        raise ValueError(f"step {kind}: {error}") from None


def result_type(step: Step, before: T.DataType) -> T.DataType:
    """The type a value has after the step."""
    match step:
        case Trim() | Upper() | Lower():
            return _STRING
        case Cast(type=name):
            return parse_sql_type(name)
        case ParseDate():
            return T.DateType()
        case ParseTimestamp():
            return T.TimestampType()
        case _:
            return before


def _plain(values) -> list[str]:
    """Of a step's constants, those that are not plain text."""
    return [v for v in values if not isinstance(v, str) or not re.fullmatch(SIMPLE_TEXT, v)]


def readable(value: str, data_type: T.DataType) -> bool:
    """Whether Spark reads the text as a value of the type; a default that it can't read would be null.

    The cast of a constant is folded when the query is planned, so no job runs.
    """
    folded = SparkSession.active().sql(f"SELECT try_cast(:value AS {data_type.simpleString()}) IS NOT NULL FROM VALUES (1)", args={"value": value})
    return folded.collect()[0][0]


def _null_if_problem(step: NullIf, before: T.DataType) -> str | None:
    if not step.values:
        return "null_if needs a value"
    return f"null_if values {_plain(step.values)} are not plain text" if _plain(step.values) else None


def _cast_problem(step: Cast, before: T.DataType) -> str | None:
    return None if normalize_sql_type(step.type) else f"cast to unsupported type {step.type!r}"


def _layout_problem(known: tuple[str, ...]):
    return lambda step, before: None if step.format in known else f"layout {step.format!r} is not among {', '.join(known)}"


def _default_problem(step: Default, before: T.DataType) -> str | None:
    if not step.value or _plain([step.value]):
        return f"default {step.value!r} is not plain text"
    return None if readable(step.value, before) else f"default {step.value!r} is no {before.simpleString()}"


# What can be wrong with a step of each kind, given the type of what it gets.
_PROBLEMS = {
    NullIf: _null_if_problem,
    Cast: _cast_problem,
    ParseDate: _layout_problem(DATE_FORMATS),
    ParseTimestamp: _layout_problem(TIMESTAMP_FORMATS),
    Default: _default_problem,
}


def step_problem(step: Step, before: T.DataType) -> str | None:
    """What is wrong with a step on a value of type `before`, if anything."""
    check = _PROBLEMS.get(type(step))
    return check(step, before) if check else None


def apply_step(step: Step, value: Column, data_type: T.DataType) -> Column:
    text = value.cast("string")
    match step:
        case Trim():
            return F.trim(text)
        case Upper():
            return F.upper(text)
        case Lower():
            return F.lower(text)
        case NullIf(values=values):
            return F.when(~F.coalesce(F.trim(text).isin(*values), F.lit(False)), value)
        case Cast(type=name):
            return value.try_cast(parse_sql_type(name))
        case ParseDate(format=layout):
            return F.try_to_timestamp(text, F.lit(layout)).cast("date")
        case ParseTimestamp(format=layout):
            return F.try_to_timestamp(text, F.lit(layout))
        case Default(value=constant):
            return F.coalesce(value, F.lit(constant).try_cast(data_type))
    raise ValueError(f"unknown step {step!r}")


def conversion_failed(before: Column, after: Column) -> Column:
    """A value was there, but the conversion gave null."""
    return before.isNotNull() & after.isNull()


@dataclass(frozen=True)
class Compiled:
    value: Column
    failed: Column | None  # None when no step can fail
    type: T.DataType


def compile_steps(value: Column, data_type: T.DataType, steps: tuple[Step, ...]) -> Compiled:
    """The steps as one expression, with the condition under which one of its conversions failed."""
    failures = []
    for step in steps:
        after = apply_step(step, value, data_type)
        if isinstance(step, (Cast, ParseDate, ParseTimestamp)):
            failures.append(conversion_failed(value, after))
        value, data_type = after, result_type(step, data_type)
    failed = functools.reduce(operator.or_, failures) if failures else None
    return Compiled(value, failed, data_type)

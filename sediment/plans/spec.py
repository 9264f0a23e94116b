"""What a Silver job builds, as plain data, and the check of it before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from sediment.functions.rules import is_allowed
from sediment.functions.steps import Step, apply_step, result_type, step_from_dict, step_problem
from sediment.types import col, sql_type_of

QUARANTINE = "_quarantine"

# Approximate or unordered values make no business key.
_NO_KEY = (T.DoubleType, T.FloatType, T.BinaryType, T.BooleanType)


class SpecError(ValueError):
    """All problems of a specification."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Attribute:
    name: str
    source: str
    steps: tuple[Step, ...] = ()
    required: bool = False
    type: str | None = None  # by default what the steps give


@dataclass(frozen=True)
class MasterKey:
    column: str
    crosswalk: str
    system_column: str
    key_column: str
    master_column: str
    entity_type_column: str | None = None
    entity_type: str | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    target: str
    business_key: tuple[str, ...]
    attributes: tuple[Attribute, ...]
    master_key: MasterKey | None = None
    quarantine: str | None = None  # by default the target's name with `_quarantine`

    @property
    def quarantine_table(self) -> str:
        return self.quarantine or self.target + QUARANTINE


@dataclass(frozen=True)
class SilverSpec:
    bronze: str
    sightings: str
    system: str
    entities: tuple[Entity, ...]
    unknown_master_key: str = "UNKNOWN"
    extra: dict = field(default_factory=dict)


def entity_from_dict(data: dict) -> Entity:
    """An entity from its plain-data form."""
    attributes = tuple(
        Attribute(
            a["name"], a.get("from", a["name"]), tuple(step_from_dict(s) for s in a.get("steps", ())),
            a.get("required", False), a.get("type"),
        )
        for a in data["attributes"]
    )
    master = data.get("master_key")
    return Entity(
        data["name"], data["target"], tuple(data["business_key"]), attributes,
        MasterKey(**master) if master else None, data.get("quarantine"),
    )


def silver_from_dict(data: dict) -> SilverSpec:
    source = data["source"]
    return SilverSpec(
        source["bronze"], source.get("sightings", source["bronze"] + "_sightings"), source["system"],
        tuple(entity_from_dict(e) for e in data["entities"]), data.get("unknown_master_key", "UNKNOWN"),
    )


def _analysis_problem(spark: SparkSession, step: Step, data_type: T.DataType) -> str | None:
    """What Spark's analysis says about a step on a column of the type (an illegal cast, for one)."""
    empty = spark.createDataFrame([], T.StructType([T.StructField("v", data_type)]))
    try:
        empty.select(apply_step(step, col("v"), data_type)).schema
    except AnalysisException as error:
        return f"Spark refuses it ({error.getCondition()})"
    return None


def _index(names) -> dict[str, str]:
    """Names by their small letters; the first of several wins."""
    found: dict[str, str] = {}
    for name in names:
        found.setdefault(name.lower(), name)
    return found


def _repeated(names) -> list[str]:
    """Names that occur more than once, whatever their case."""
    small = [n.lower() for n in names]
    return sorted({n for n in small if small.count(n) > 1})


class _Resolved:
    """An entity next to what the tables have: every name it uses with the column or attribute behind it, if there is one.

    Resolving never fails; the checks below look at what is left open, each on its own.
    """

    def __init__(self, spark: SparkSession, entity: Entity, source: T.StructType, crosswalk: T.StructType | None):
        columns, own = _index(source.names), _index(a.name for a in entity.attributes)
        self.spark, self.entity = spark, entity
        self.sources = [columns.get(a.source.lower()) for a in entity.attributes]
        self.keys = [own.get(k.lower()) for k in entity.business_key]
        self.own = own
        self.stored = None if crosswalk is None else _index(crosswalk.names)
        self.step_problems: list[str] = []
        self.types = [source[c].dataType if c else None for c in self.sources]
        self.types = [self._after_steps(a, t) if t else None for a, t in zip(entity.attributes, self.types)]

    def _after_steps(self, a: Attribute, data_type: T.DataType) -> T.DataType:
        """The type after the steps, up to the first that has a problem, which is noted."""
        for number, step in enumerate(a.steps, 1):
            problem = step_problem(step, data_type) or _analysis_problem(self.spark, step, data_type)
            if problem:
                self.step_problems.append(f"{a.name}, step {number}: {problem}")
                break
            data_type = result_type(step, data_type)
        return data_type

    def roles(self) -> dict[str, str]:
        """The crosswalk columns that a master key names."""
        mk = self.entity.master_key
        named = {"system": mk.system_column, "key": mk.key_column, "master key": mk.master_column, "entity type": mk.entity_type_column}
        return {role: name for role, name in named.items() if name is not None}

    def done(self) -> Entity:
        """The entity under its real names.  Only for one without problems."""
        attributes = tuple(
            replace(a, source=source, type=a.type or sql_type_of(data_type), required=a.required or a.name in self.keys)
            for a, source, data_type in zip(self.entity.attributes, self.sources, self.types)
        )
        mk = self.entity.master_key
        if mk and self.stored:
            fields = ("system_column", "key_column", "master_column", "entity_type_column")
            mk = replace(mk, **{f: self.stored[getattr(mk, f).lower()] for f in fields if getattr(mk, f) is not None})
        return replace(
            self.entity, attributes=attributes, business_key=tuple(self.keys), master_key=mk, quarantine=self.entity.quarantine_table
        )


def _bad_names(r: _Resolved):
    if not is_allowed("identifier", r.entity.name):
        yield f"{r.entity.name!r} is no table name"
    columns = [a.name for a in r.entity.attributes] + ([r.entity.master_key.column] if r.entity.master_key else [])
    for name in columns:
        if not is_allowed("identifier", name):
            yield f"{name!r} is no column name"
        elif name.startswith("_"):
            yield f"{name!r}: names with a leading underscore are reserved"
    for name in _repeated(columns):
        yield f"column {name!r} is defined more than once"


def _bad_sources(r: _Resolved):
    if not r.entity.attributes:
        yield "there is no attribute"
    for a, found in zip(r.entity.attributes, r.sources):
        if found is None:
            yield f"{a.name}: the source has no column {a.source!r}"


def _bad_steps(r: _Resolved):
    yield from r.step_problems


def _bad_keys(r: _Resolved):
    if not r.entity.business_key:
        yield "there is no business key"
    for key, name in zip(r.entity.business_key, r.keys):
        if name is None:
            yield f"business key {key!r} is no attribute"
    for key in _repeated(r.entity.business_key):
        yield f"business key {key!r} is listed more than once"
    for a, data_type in zip(r.entity.attributes, r.types):
        if a.name in r.keys and isinstance(data_type, _NO_KEY):
            yield f"{a.name}: values of type {data_type.simpleString()} make no business key"


def _bad_master(r: _Resolved):
    mk = r.entity.master_key
    if mk is None:
        return
    if len(r.entity.business_key) != 1:
        yield "a master key is looked up by one business key"
    if (mk.entity_type is None) != (mk.entity_type_column is None):
        yield "an entity type takes a column and a value"
    if mk.entity_type is not None and not (mk.entity_type and is_allowed("simple_text", mk.entity_type)):
        yield f"entity type {mk.entity_type!r} is not plain text"
    for name in _repeated(r.roles().values()):
        yield f"crosswalk column {name!r} has more than one role"
    for role, name in r.roles().items():
        if r.stored is not None and name.lower() not in r.stored:
            yield f"the crosswalk has no {role} column {name!r}"


_CHECKS = (_bad_names, _bad_sources, _bad_steps, _bad_keys, _bad_master)


def compile_entity(
    spark: SparkSession, entity: Entity, source: T.StructType, crosswalks: dict[str, T.StructType] | None = None
) -> Entity:
    """The entity with its names and types resolved against the Bronze schema.

    Raises SpecError with all problems.  `crosswalks` maps the names of crosswalk tables to their
    schemas; a crosswalk not in it is not checked.
    """
    crosswalk = (crosswalks or {}).get(entity.master_key.crosswalk) if entity.master_key else None
    resolved = _Resolved(spark, entity, source, crosswalk)
    problems = [f"{entity.name}: {p}" for check in _CHECKS for p in check(resolved)]
    if problems:
        raise SpecError(problems)
    return resolved.done()


def _bad_job(spec: SilverSpec):
    if not spec.entities:
        yield "there is no entity"
    if not is_allowed("identifier", spec.system):
        yield f"source system {spec.system!r} is no name"
    if not (spec.unknown_master_key and is_allowed("simple_text", spec.unknown_master_key)):
        yield f"unknown master key {spec.unknown_master_key!r} is not plain text"
    written = [t for e in spec.entities for t in (e.target, e.quarantine_table)]
    for name in _repeated(written):
        yield f"more than one table would be {name!r}"
    if spec.bronze.lower() in [t.lower() for t in written]:
        yield f"{spec.bronze!r} is what the job reads"


def compile_silver(spark: SparkSession, spec: SilverSpec) -> SilverSpec:
    """The whole specification against the tables it names."""
    problems, entities = list(_bad_job(spec)), []
    source = spark.table(spec.bronze).schema
    for entity in spec.entities:
        named = [entity.master_key.crosswalk] if entity.master_key else []
        try:
            entities.append(compile_entity(spark, entity, source, {t: spark.table(t).schema for t in named}))
        except SpecError as error:
            problems += error.problems
    if problems:
        raise SpecError(problems)
    return replace(spec, entities=tuple(entities))

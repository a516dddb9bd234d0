"""Nested JSON records held against a declared contract."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of an analysis record, in order. A field is its kind, then what it has to keep to; `!` marks one that its object must have.
ANALYSIS = {
    "analysis_id!": "string",
    "timestamp!": "string",
    "location!": {"name!": "string", "coordinates!": ["number"]},
    "satellite_data!": {"source!": "string", "scene_date!": "string", "cloud_cover_percentage": "number"},
    "water_detection!": {"model_used!": "string", "water_surface_area_sq_km!": "number", "mask_geojson_url": "string"},
    "contamination_detection!": {
        "model_used!": "string",
        "indicators!": {"ndwi": "number", "ndti": "number", "ndci": "number", "turbidity": "number"},
        "anomaly_status!": ("string", ("NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")),
        "confidence_score!": ("number", 0, 1),
        "detected_contaminants": ["string"],
    },
    "investigation_priority!": {"score!": ("number", 0, 100), "recommendation": "string"},
}
_KINDS = {"string": r"^STRING$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "object": r"^OBJECT<", "array": r"^ARRAY<"}


def _is(kind: Column, wanted: str) -> Column:
    return F.coalesce(kind.rlike(_KINDS[wanted]), F.lit(False))


def _fields(spec: dict, path: str = "") -> Iterator[str]:
    for field, rule in spec.items():
        yield (where := f"{path}.{field.rstrip('!')}")
        if isinstance(rule, dict):
            yield from _fields(rule, where)


def _rules(values: dict[str, Column], kinds: dict[str, Column], spec: dict, path: str, there: Column) -> Iterator[tuple[str, Column]]:
    """(reason, whether it holds) of every rule in the contract's order; a field's rules hold only where its object is one."""
    for field, rule in spec.items():
        name, needed = field.rstrip("!"), field.endswith("!")
        where = f"{path}.{name}"
        value, own = values[where], kinds[where]
        has = there & value.isNotNull()
        label = where[1:]
        if needed:
            yield f"{label}:missing", there & value.isNull()
        kind = "object" if isinstance(rule, dict) else "array" if isinstance(rule, list) else rule if isinstance(rule, str) else rule[0]
        yield f"{label}:type", has & ~_is(own, kind)
        if isinstance(rule, dict):
            yield from _rules(values, kinds, rule, where, has & _is(own, "object"))
        elif isinstance(rule, list):
            yield f"{label}:items", has & F.coalesce(F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda x: ~_is(F.schema_of_variant(x), rule[0])), F.lit(False))
        elif isinstance(rule, tuple) and kind == "string":
            yield f"{label}:enum", has & ~F.coalesce(F.try_variant_get(value, "$", "string").isin(*rule[1]), F.lit(False))
        elif isinstance(rule, tuple):
            yield f"{label}:range", has & ~F.coalesce(F.try_variant_get(value, "$", "double").between(*rule[1:]), F.lit(False))


def checked(records: DataFrame, column: str = "record", spec: dict = ANALYSIS) -> DataFrame:
    """Adds reason: null for a record that keeps to the contract, else the first rule in the contract's order that it breaks, as path:rule.

    Rules: json (no JSON object at all), missing (of a required field), type, items (an array with an element of another kind), enum, range. Fields that the contract doesn't name are let through. A record is parsed once,
    each field is taken from it once and its kind told once, and no Python runs.
    """
    parsed = records.withColumn("__record", F.try_parse_json(F.col(column)))
    paths = list(_fields(spec))
    values = F.struct(*(F.try_variant_get("__record", "$" + w, "variant").alias(f"v{i}") for i, w in enumerate(paths)))
    kinds = F.struct(*(F.schema_of_variant(F.col(f"__values.v{i}")).alias(f"k{i}") for i in range(len(paths))), F.schema_of_variant("__record").alias("k"))
    x = parsed.withColumn("__values", values).withColumn("__kinds", kinds)
    reason = F.when(~_is(F.col("__kinds.k"), "object"), "json")
    of = lambda c: {w: F.col(f"{c}{i}") for i, w in enumerate(paths)}
    for name, broken in _rules(of("__values.v"), of("__kinds.k"), spec, "", F.lit(True)):
        reason = reason.when(broken, name)
    return x.withColumn("reason", reason).drop("__record", "__values", "__kinds")


def store_checked(records: DataFrame, path: str, column: str = "record", spec: dict = ANALYSIS) -> None:
    """Writes all records in one pass: those that keep to the contract under `path`/accepted=true, the rejected with their reasons under `path`/accepted=false.

    Records are dealt out evenly first: checking costs far more than reading, and a table of few files would be a few tasks'.
    """
    dealt = records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    checked(dealt, column, spec).withColumn("accepted", F.col("reason").isNull()).write.mode("overwrite").partitionBy("accepted").parquet(path)

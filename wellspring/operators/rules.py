"""Threshold rules per device type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.constants import FAULT_RULES
from wellspring.operators.telemetry import number_sql

Rule = tuple[str, str, str, float, float, str]


def fired_rules(
    rules: Sequence[Rule] = FAULT_RULES,
    device_type: str = "device_type",
    payload: str = "payload",
    aliases: Mapping[str, str] | None = None,
) -> Column:
    """Array of faults whose rule fires, in rule order; empty for unknown device types.

    A missing field takes the default of its rule. ``aliases`` names the payload
    field that really carries a rule's field.
    """
    aliases = aliases or {}
    checks = [
        f"CASE WHEN {device_type} = '{kind}' AND "
        f"coalesce({number_sql(aliases.get(field, field), payload)}, {default}D) {op} {threshold}D "
        f"THEN '{fault}' END"
        for kind, field, op, threshold, default, fault in rules
    ]
    return F.expr(f"array_compact(array({', '.join(checks)}))")


def detect_faults(df: DataFrame, rules: Sequence[Rule] = FAULT_RULES, **options) -> DataFrame:
    """Add the array column ``detected`` to rows with ``device_type`` and ``payload``."""
    return df.withColumn("detected", fired_rules(rules, **options))


def detect_type(df: DataFrame, device_type: str) -> DataFrame:
    """Rules of one device type over the rows of that type."""
    rules = [rule for rule in FAULT_RULES if rule[0] == device_type]
    return detect_faults(df.filter(F.col("device_type") == device_type), rules)

"""Column expressions on class labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.schema import BASELINE_LABEL, LABEL_NAMES, STRESS_LABELS


def is_valid(label: Column) -> Column:
    return label.isin(*LABEL_NAMES)


def is_stressed(label: Column) -> Column:
    return label.isin(*STRESS_LABELS)


def is_baseline(label: Column) -> Column:
    return label == BASELINE_LABEL


def recode(label: Column, old: int = 7, new: int = 5) -> Column:
    return F.when(label == old, F.lit(new)).otherwise(label)


def name_map(names: dict[int, str] | None = None) -> Column:
    pairs = [F.lit(v) for kv in (names or LABEL_NAMES).items() for v in kv]
    return F.create_map(*pairs)


def label_name(label: Column, names: dict[int, str] | None = None) -> Column:
    """Name of a label; a code outside the map reads ``Unknown(code)``."""
    known = F.try_element_at(name_map(names), label.cast("int"))
    return F.coalesce(known, F.format_string("Unknown(%d)", label.cast("int")))


def eval_name(label: Column, names: dict[int, str] | None = None) -> Column:
    """Name of a label for an evaluation table; anything else is ``Other``."""
    return F.coalesce(F.try_element_at(name_map(names), label.cast("int")), F.lit("Other"))


def stress_ratio(stress: Column, baseline: Column) -> Column:
    """stress / (stress + baseline); other classes do not dilute it; 0 without either."""
    return F.coalesce(F.try_divide(stress.cast("double"), (stress + baseline).cast("double")), F.lit(0.0))

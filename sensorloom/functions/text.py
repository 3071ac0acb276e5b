"""String and time expressions: safe ids, natural order, slugs, percent text, ISO bounds."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def fold_accents(raw: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII part only; Spark has no built-in for it."""
    return raw.map(
        lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode(),
    )


def tracking_id(raw: Column, fold: bool = True) -> Column:
    """A file-name-safe id; an empty string when nothing usable remains. Accented letters lose their
    accent (with ``fold=False`` they are dropped, and everything stays in the JVM).
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    text = fold_accents(text) if fold else text
    text = F.regexp_replace(text, "/", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", "_")
    text = F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "")
    return F.regexp_replace(text, r"^[._]+|[._]+$", "")


def natural_key(text: Column) -> Column:
    """Sort key with digit runs compared as numbers (S2 before S10): a run is preceded by its length."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = F.transform(runs, lambda r: F.regexp_replace(r, r"^0+(?=\d)", ""))
    return F.transform(bare, lambda r: F.when(r.rlike(r"^\d+$"), F.concat(F.lpad(F.length(r).cast("string"), 10, "0"), r)).otherwise(r))


def css_slug(title: Column) -> Column:
    return F.replace(F.lower(title), F.lit(" "), F.lit("-"))


def percent(x: Column, digits: int = 1) -> Column:
    return F.round(x * 100, digits)


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def delta_text(delta: Column) -> Column:
    sign = F.when(delta > 0, "+").otherwise("")
    body = F.concat(sign, F.format_string("%.1f", delta * 100), F.lit("% vs previous entry"))
    return F.when(delta.isNull(), "No previous entry yet").otherwise(body)


def iso_utc(ts: Column) -> Column:
    """Second-precision ISO text of an instant in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def history_bound(local_text: Column, is_end: bool = False, zone: str = "UTC") -> Column:
    """Minute- or second-precision local text of a zone to an instant, whatever the session's zone; end bounds cover their
    whole minute."""
    full = F.when(F.length(local_text) == 16, F.concat(local_text, F.lit(":00"))).otherwise(local_text)
    local = F.when(full.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"), full).try_cast("timestamp_ntz")
    ts = F.convert_timezone(F.lit(zone), F.current_timezone(), local).cast("timestamp")
    if is_end:
        ts = F.date_trunc("minute", ts) + F.expr("INTERVAL '59.999' SECOND")
    return ts

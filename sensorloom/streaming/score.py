"""Score feature rows as they arrive with a fitted classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import labels as L
from sensorloom.operators.learn import Fitted, stress_probability


def score_stream(features: DataFrame, model: Fitted, row_id: str) -> DataFrame:
    """Row-wise only, so it runs stateless, for every classifier of the catalogue."""
    scored = model.score(features, row_id)
    return scored.withColumns({
        "label_name": L.label_name(F.col("prediction")), "is_stressed": L.is_stressed(F.col("prediction")),
        "p_stress": stress_probability(model.labels)})

"""Stateless stages run unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilmark.operators.text import detect_spans, with_risk


def score_stream(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    return with_risk(detect_spans(df, text_col, **options))

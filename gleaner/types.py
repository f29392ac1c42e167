"""Schemas and fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

POSITIVE, NEGATIVE, UNKNOWN = "positive", "negative", "unknown"
STATUSES, QUALITIES = (POSITIVE, NEGATIVE, UNKNOWN), ("gold", "silver", "weak")

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LABEL = _struct(status=_S, quality=_S, source=_S, rubric_version=_S, confidence=_D, annotators=T.ArrayType(_S), adjudicated=_B)
LABELS = T.MapType(_S, LABEL)
METRICS = _struct(metrics_version=_S, effective_loc=_I, parameter_count=_I, max_nesting=_I, parser=_S)
SAMPLE = _struct(
    sample_id=_S, dataset=_S, repository_url=_S, repository_family_id=_S, commit_sha=_S, file_path=_S, start_line=_I, end_line=_I,
    language=_S, sample_type=_S, symbol=_S, code=_S, context=_S, license=_S, provenance=_S, labels=_S, static_metrics=_S,
    content_hash=_S, fingerprint=_S, extraction_version=_S, rubric_version=_S,
)

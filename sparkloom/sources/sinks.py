"""Sinks: appended results, partitioned results, reports, and models checked by reading them back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_rows(df: DataFrame, path: str) -> None:
    """Append; a finished file is never read and rewritten."""
    df.write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def split_by(df: DataFrame, condition: str, path_if: str, path_else: str) -> None:
    df.filter(condition).write.mode("overwrite").parquet(path_if)
    df.filter(f"not coalesce({condition}, false)").write.mode("overwrite").parquet(path_else)


def save_with_report(df: DataFrame, report: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/table")
    report.write.mode("overwrite").json(f"{path}/report")


def with_provenance(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def save_model(model: PipelineModel, path: str, sample: DataFrame, output: str, metadata: Mapping) -> dict:
    """Save, load again and compare the scores of ``sample`` exactly; returns metadata with the outcome."""
    from pyspark.ml.functions import vector_to_array

    model.write().overwrite().save(path)
    again = PipelineModel.load(path)

    def scores(m: PipelineModel) -> DataFrame:
        out = m.transform(sample)
        value = vector_to_array(output) if out.schema[output].dataType.typeName() == "vectorudt" else F.col(output)
        return out.select(*sample.columns, value.alias("_score"))

    same = scores(model).exceptAll(scores(again)).isEmpty()
    return {**metadata, "round_trip": same, "path": path}

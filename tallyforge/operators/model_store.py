"""Versions of models as a table: what a fit learned from, how it did on rows it hadn't seen, and which version is in use."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import exists
from .boosting import Model

VERSIONS = "name string, version long, model string, trained_on array<string>, holdout array<string>, metrics string, promoted boolean, refit_of long"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of all models in a folder."""
    if not exists(spark, folder):
        return spark.createDataFrame([], VERSIONS)
    return spark.read.schema(VERSIONS).option("recursiveFileLookup", "true").parquet(folder)


def save(spark: SparkSession, folder: str, name: str, model: Model, trained_on: list[str], holdout: list[str], promoted: bool, refit_of: int | None = None) -> int:
    """Add a version; the keys tell which rows it has seen and which it was measured on. Returns its number."""
    last = versions(spark, folder).filter(F.col("name") == name).agg(F.max("version")).first()[0] or 0
    row = (name, last + 1, model.to_json(), trained_on, holdout, json.dumps(model.metrics), promoted, refit_of)
    spark.createDataFrame([row], VERSIONS).coalesce(1).write.parquet(f"{folder}/version-{name}-{last + 1}-{uuid.uuid4().hex}")
    return last + 1


def active(spark: SparkSession, folder: str, name: str) -> tuple[int, Model] | None:
    """The newest promoted version, or None."""
    found = versions(spark, folder).filter((F.col("name") == name) & F.col("promoted")).orderBy(F.desc("version")).limit(1).collect()
    return (found[0].version, Model.from_json(found[0].model)) if found else None


def active_or_fit(spark: SparkSession, folder: str, name: str, fit: Callable[[], tuple[Model, list[str], list[str]]]) -> tuple[int, Model]:
    """The version in use; only where there is none a fit is made, and promoted."""
    found = active(spark, folder, name)
    if found:
        return found
    model, trained_on, holdout = fit()
    return save(spark, folder, name, model, trained_on, holdout, True), model


def refit_on_all(spark: SparkSession, folder: str, name: str, version: int, fit: Callable[[int], Model]) -> int:
    """A version that learns from all rows, held-out ones too, for as many rounds as the version it comes from.

    It keeps that version's metrics and held-out keys, as it can't be measured on rows that it has seen.
    """
    old = versions(spark, folder).filter((F.col("name") == name) & (F.col("version") == version)).first()
    if old is None:
        raise ValueError(f"{name} has no version {version}")
    metrics = json.loads(old.metrics)
    model = fit(metrics["rounds"])
    model.metrics, model.temperature = metrics, Model.from_json(old.model).temperature
    return save(spark, folder, name, model, sorted({*old.trained_on, *old.holdout}), old.holdout, old.promoted, version)

"""Few-shot preparation: from a file listing to paired labeled and unlabeled pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators import selection
from scriptoria.sources import files as sources


@dataclass
class Prepared:
    """Tables a training job reads."""

    manifest: DataFrame
    labeled: DataFrame
    unlabeled: DataFrame
    pairs: DataFrame


def prepare_few_shot(
    spark: SparkSession,
    files: DataFrame,
    family: str,
    manuscript: str,
    k: int,
    method: str = "random",
    notes_path: str | None = None,
    seed: int = 42,
    variances: DataFrame | None = None,
) -> Prepared:
    """Choose k labeled training pages of one manuscript and pair the rest with them.

    *variances* (stem, variance) is needed by the gray variance method.
    """
    pages = sources.manifest(files, family).filter(F.col("manuscript") == manuscript)
    train = pages.filter("split = 'train'")
    ranked = train if variances is None else train.join(variances, "stem", "left").fillna(0.0, ["variance"])
    chosen = selection.select_labeled(spark, ranked, k, method, notes_path, seed)
    labeled, unlabeled = selection.split_labeled(train, chosen)
    return Prepared(pages, labeled, unlabeled, selection.cyclic_pairs(labeled, unlabeled))

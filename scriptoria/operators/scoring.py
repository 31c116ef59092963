"""Scoring of windows or crops with a model the caller supplies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import types as T


def score_batches(
    values: Column,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    shape: list[int],
    batch_size: int = 256,
    return_type: T.DataType | None = None,
) -> Column:
    """Apply a model to array rows in batches; the model is made once per Python worker."""
    run = predict_batch_udf(
        make_model, return_type=return_type or T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[shape]
    )
    return run(values)

"""Text to vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revgauge import fixed_values as fv
from revgauge.functions import text


def encode_hashed(df: DataFrame, column: str, out: str = "embedding", size: int = fv.VECTOR_SIZE,
                  normalize: bool = True) -> DataFrame:
    """Deterministic vectors without a model: hashed word counts, scaled to length 1 unless told otherwise. A text
    without words is a zero vector."""
    df = df.withColumn("_words", text.tokenize_simple(F.coalesce(F.col(column), F.lit(""))))
    df = HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf").transform(df)
    if normalize:
        df = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(df)
    return (df.withColumn(out, vector_to_array("_unit" if normalize else "_tf", "float32"))
            .drop("_words", "_tf", "_unit"))


def encode_text(df: DataFrame, column: str, make_encoder: Callable[[], Callable] | None = None,
                out: str = "embedding", size: int = fv.VECTOR_SIZE, batch_size: int = fv.ENCODE_BATCH,
                normalize: bool = True) -> DataFrame:
    """Encode a text column. ``make_encoder`` runs once per Python worker and returns a function from an array of
    texts to a matrix; without it the hashed encoder is used."""
    if make_encoder is None:
        return encode_hashed(df, column, out, size, normalize)

    def make_predict():
        encode = make_encoder()

        def predict(texts: np.ndarray) -> np.ndarray:
            m = np.asarray(encode(texts), dtype="float32")
            if normalize:
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            return m

        return predict

    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, predict(F.coalesce(F.col(column), F.lit(""))))

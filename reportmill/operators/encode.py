"""Vectors from texts: a pluggable encoder with a deterministic default, and the incremental cache of what is encoded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.functions import text as words
from reportmill.sources import writers

#: From texts to one vector each; made once per worker, so it may load a model.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def encoded(df: DataFrame, key: str = "source_id", column: str = "narrative", dim: int = 384, encoder: Encoder | None = None, batch: int = 64, max_chars: int | None = None) -> DataFrame:
    """(key, embedding array<float>): a vector of length 1 for every row with a key.

    Without an encoder, words and word pairs are hashed into ``dim`` counts, damped by the logarithm, in the JVM and without a
    shuffle. With one, texts go to it in batches of ``batch``; ``max_chars`` cuts them for encoders that read no further
    (None: whole texts). Null and empty texts, and those without a word, get the zero vector.
    """
    t = F.coalesce(F.col(column), F.lit(""))
    rows = df.where(F.col(key).isNotNull()).select(key, (F.substring(t, 1, max_chars) if max_chars else t).alias("_text"))
    if encoder is None:
        terms = F.flatten(F.transform(F.array(words.tokens(F.col("_text"), [])), lambda w: words.ngrams(w, 1, 2)))
        counts = HashingTF(numFeatures=dim, inputCol="_terms", outputCol="_v").transform(rows.select(key, terms.alias("_terms")))
        damped = counts.select(key, F.transform(vector_to_array("_v"), lambda x: F.log1p(x)).alias("_d"))
        length = F.sqrt(F.aggregate("_d", F.lit(0.0), lambda s, x: s + x * x))
        return damped.select(key, "_d", length.alias("_n")).select(key, F.when(F.col("_n") > 0, F.transform("_d", lambda x: x / F.col("_n"))).otherwise(F.col("_d")).cast("array<float>").alias("embedding"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for b in (whole.slice(at, batch) for whole in batches for at in range(0, whole.num_rows, batch)):
            texts = b.column(1).to_pylist()
            out = np.zeros((len(texts), dim), np.float32)
            some = [k for k, x in enumerate(texts) if x]
            if some:
                out[some] = model([texts[k] for k in some])
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dim).cast(pa.list_(pa.float32()))], [key, "embedding"])

    return rows.mapInArrow(encode, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def refreshed(cache: DataFrame, df: DataFrame, key: str = "source_id", **how: object) -> DataFrame:
    """The cache (key, embedding) with vectors for the rows of ``df`` it lacks; only those are encoded, each key once."""
    missing = df.join(cache.where("embedding IS NOT NULL").select(key), key, "left_anti").dropDuplicates([key])
    return writers.upserted(cache, encoded(missing, key, **how), key)

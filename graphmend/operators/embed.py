"""Embedding inputs: external vectors or a built-in hashed n-gram embedder.

The reference calls an embedding service.  Here the service is optional:
external vectors come in through ``responses.ingest_embeddings``; without a
service, ``hash_embed`` builds deterministic character-n-gram vectors with
MLlib's JVM feature transformers (n-grams -> feature hashing -> L2 norm).
Whole texts are used; nothing is truncated.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_DIM = 1536  # same width as the service vectors the blocks were tuned on


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = HASH_DIM, n: int = 3) -> DataFrame:
    """(id, embedding array<double>) from lower-cased character ``n``-grams.

    Overlapping n-grams come from one regex pass (a look-ahead capture), then
    feature hashing and L2 normalisation run in the JVM.
    """
    grams = df.select(
        F.col(id_col).alias("id"),
        F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"(?s)(?=(.{{{n}}}))"), 1).alias("_grams"),
    )
    pipe = Pipeline(stages=[
        HashingTF(numFeatures=dim, inputCol="_grams", outputCol="_tf"),
        Normalizer(p=2.0, inputCol="_tf", outputCol="_v"),
    ])
    model = pipe.fit(grams.limit(0))  # stateless stages: fitting reads no data
    return model.transform(grams).select("id", vector_to_array("_v").alias("embedding"))

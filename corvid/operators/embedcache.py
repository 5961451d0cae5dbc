"""Vectors of texts kept from one job to the next, by content.

A text's key is its SHA-256 digest, under the name of the model that made the vector. Of a
table's distinct texts only those without a vector are embedded; their vectors are
appended to a ``Store``, in one version. Two writers may embed one text at the same
time and both append it: readers take one vector of each key, which are equal as long
as a model gives a text one vector. Keys fall into buckets by their first digit, and a
file holds whole ranges of keys, so that a lookup of few texts reads few files: what
the store knows of a file's keys rules it out where a list of at most ``LISTED`` keys asks.

Null texts have a null vector. Repeated rows keep their number; other columns stay. An
empty table embeds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store

#: Keys that are looked up by a list in the filter; more are looked up by a join alone.
LISTED = 1000


class EmbeddingCache:
    """A folder of vectors for a model of this ``name``."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.name = spark, name
        self.store = Store(spark, path, {"model": "string", "digest": "string"})

    def _known(self, keys: DataFrame | None = None) -> DataFrame:
        """digest, vector of this model; of ``keys (digest)`` if they are given."""
        if not self.store.version():
            return self.spark.createDataFrame([], "digest string, vector array<double>")
        where: dict = {"model": self.name}
        if keys is not None:
            few = [r[0] for r in keys.limit(LISTED + 1).collect()]
            if not few:
                return self.spark.createDataFrame([], "digest string, vector array<double>")
            if len(few) <= LISTED:
                where["digest"] = {"$in": few}
        rows = self.store.read(where=where).select(F.col("metadata")["digest"].alias("digest"), "vector")
        return rows.dropDuplicates(["digest"])

    def embed(self, rows: DataFrame, embed: Callable[[Column], Column], text: str = "text", name: str = "vector") -> tuple[DataFrame, int]:
        """``rows`` with the vectors of their texts, and how many texts had to be embedded."""
        keyed = rows.withColumn("_digest", F.sha2(F.col(text), 256))
        texts = keyed.where(F.col("_digest").isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.first(text).alias("_text"))
        missing = texts.join(self._known(texts.select("digest")).select("digest"), "digest", "left_anti")
        made = 0
        if not missing.isEmpty():
            new = missing.select(embed(F.col("_text")).cast("array<double>").alias("vector"), F.create_map(F.lit("model"), F.lit(self.name), F.lit("digest"), F.col("digest")).alias("metadata"), F.col("digest").alias("_by"))
            made = self.store.add(new.repartitionByRange("_by").sortWithinPartitions("_by").drop("_by"))
        found = self._known(texts.select("digest")).withColumnsRenamed({"digest": "_digest", "vector": name})
        return keyed.join(found, "_digest", "left").drop("_digest"), made

"""Results kept between runs by the digest of the content they were made from.

A store is a folder: ``results`` and ``digests`` by batch, and ``commits`` with a row per finished batch. Whether a
document's result is known is told where its content is read: digests are tested against a Bloom filter
of bounded size. What the filter can't decide is decided by digests alone. Contents cross an exchange only for the few rows
both filters are wrong about.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.operators.layout import digest
from pagewright.session import cut_lineage

#: Hashes per digest, bits per digest, and the least and most bits of a filter (2 ** 25: 4 MB). More digests than a full
#: filter is good for cost work, not results.
HASHES, BITS_PER_DIGEST, LEAST_BITS, MOST_BITS = 5, 10, 1 << 12, 1 << 25


def _bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_PER_DIGEST - 1).bit_length()))


def bloom_filter(digests: DataFrame, n: int) -> DataFrame:
    """One row: ``_bits``, the filter's bits in an array of longs. ``n``: about how many digests there are."""
    size = _bits(max(1, n))
    at = F.explode(F.array(*[F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(size)) for i in range(HASHES)])).alias("_at")
    words = (digests.select(at).select(F.expr("_at div 64").alias("_w"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("_b"))
             .groupBy("_w").agg(F.bit_or("_b").alias("_b")))
    empty = digests.sparkSession.range(size // 64).select(F.col("id").alias("_w"), F.lit(0).cast("long").alias("_b"))
    words = words.unionByName(empty).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    # at most MOST_BITS / 64 words, whatever the number of digests
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_b"))), lambda x: x["_b"]).alias("_bits"))


def _tested(rows: DataFrame, digests: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: whether a filter of ``digests`` may hold their digest. The filter is a value in the plan, no join."""
    n = digests.count()
    bits, size = cut_lineage(bloom_filter(digests, n)).scalar(), F.lit(_bits(max(1, n)))
    at = lambda i: F.pmod(F.xxhash64("digest", F.lit(i)), size)
    word = lambda i: F.get(bits, F.shiftright(at(i), 6).cast("int"))
    held = [F.call_function("shiftright", word(i), (at(i) % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
            for i in range(HASHES)]
    return rows.withColumn(name, reduce(Column.__and__, held))


def split_known(documents: DataFrame, digests: DataFrame, content: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents whose digest is in ``digests``, the others), both with all their columns and ``digest``.

    Exact. A document the filter of known digests misses is new. Of those it may hold, the digests decide; the wrongly held
    ones, few, make a second filter. A row that passes the first and not the second is known. Only rows that pass both
    meet the digests by a join.
    """
    known = cut_lineage(digests.filter(F.col("digest").isNotNull()).select("digest").distinct())
    named = documents.withColumn("digest", digest(content))
    held = _tested(named.select("digest"), known, "_held").filter("_held").select("digest").distinct()
    wrong = cut_lineage(held.join(known, "digest", "left_anti"))
    marked = _tested(_tested(named, known, "_held"), wrong, "_doubt")
    none = F.col("digest").isNull()  # a null content has no result
    doubtful = marked.filter("_held AND _doubt")
    drop = ["_held", "_doubt"]
    yes = marked.filter("_held AND NOT _doubt").unionByName(doubtful.join(wrong, "digest", "left_anti").select(*marked.columns))
    no = marked.filter(none | ~F.col("_held")).unionByName(doubtful.join(wrong, "digest", "left_semi").select(*marked.columns))
    return yes.filter(~none).drop(*drop), no.drop(*drop)


class ResultStore:
    """Results by digest in the folder ``path``, added batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._schema = None

    def _batches(self) -> list[int]:
        """Finished batches: a failed or running one is not among them."""
        try:
            return sorted(r["batch"] for r in self.spark.read.parquet(f"{self.path}/commits").select("batch").collect())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def add(self, results: DataFrame, batch: int) -> None:
        """Store ``results`` (digest, ...) as a batch; the same batch again replaces it."""
        rows = results.filter(F.col("digest").isNotNull())
        at = lambda name: f"{self.path}/{name}/batch={batch}"
        rows.repartitionByRange("digest").sortWithinPartitions("digest").write.mode("overwrite").parquet(at("results"))
        stored = self.spark.read.schema(rows.schema).parquet(at("results"))
        stored.select("digest").distinct().write.mode("overwrite").parquet(at("digests"))
        self.spark.read.schema("digest string").parquet(at("digests")).agg(F.count("*").alias("digests")).coalesce(1).write.mode(
            "overwrite").parquet(at("commits"))

    def _table(self, name: str) -> DataFrame | None:
        batches = self._batches()
        if not batches:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(
            *[f"{self.path}/{name}/batch={b}" for b in batches])

    def digests(self) -> DataFrame:
        found = self._table("digests")
        return self.spark.createDataFrame([], "digest string") if found is None else found.select("digest").distinct()

    def results(self) -> DataFrame | None:
        """Stored rows; where several batches have a digest those of the latest. None: nothing is stored yet."""
        found = self._table("results")
        if found is None:
            return None
        latest = self._table("digests").groupBy("digest").agg(F.max("batch").alias("batch"))
        return found.join(latest, ["digest", "batch"], "left_semi").drop("batch")

    def split(self, documents: DataFrame, content: str = "text") -> tuple[DataFrame, DataFrame]:
        """(documents with a stored result, documents still to be processed); see ``split_known``."""
        return split_known(documents, self.digests(), content)

    def reuse(self, documents: DataFrame, process, batch: int, content: str = "text", key: str = "doc_id") -> DataFrame:
        """(key, digest, result columns) for all ``documents``; ``process`` runs over one document of each new content only.

        ``process`` takes documents with ``digest`` and returns rows with ``digest``; what it returns is stored as ``batch``.
        """
        _, new = self.split(documents, content)
        ids = cut_lineage(documents.select(key, digest(content).alias("digest")))
        one = ids.groupBy("digest").agg(F.min(key).alias(key))
        once = new.join(one, ["digest", key], "left_semi").dropDuplicates(["digest"])
        done = process(once)
        if not once.isEmpty() or self.results() is None:
            self.add(done, batch)
        return ids.join(self.results(), "digest")

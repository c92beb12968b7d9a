"""An inverted index of documents as stored tables, and many queries searched in it at once.

An index is a folder: ``postings`` (term, keys, tfs, docs) and ``terms`` (term, df) by segment and by a bucket of the term's
hash, ``documents`` (key, words, copies) by segment, and ``commits`` with a row per finished segment. A row of ``postings`` is
a block: a term, and the documents of one slice of the input that hold it. A bucket's
blocks are dealt into pieces by slice, so a frequent word is the work of many tasks, and sorted by term in each, so a rare word
lies in a few row groups. A search reads the buckets its words are in and never a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructType

#: Buckets of term hashes, the unit a search skips by.
BUCKETS = 64
#: Bytes of text whose postings are put together as blocks at once; a longer text is a slice of its own.
SLICE_BYTES = 16 << 20
#: Query words up to this number are counted and sent to the tasks; more meet the postings by a shuffled join.
SENT_WORDS = 200_000
#: Words whose postings are sorted by one task of a build, and (query, document) pairs one task of a search can meet at most.
PIECE_WORDS, TASK_PAIRS = 2_000_000, 1_000_000


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")


def _block(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row per word of a slice: (term, keys, tfs, docs). Blanks are space and tab to carriage return."""
    split = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(split)
    real = pc.not_equal(words, "")  # a blank at an end leaves an empty word
    coded = words.filter(real).dictionary_encode()
    at = pc.list_parent_indices(split).filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    met, tfs = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(texts) + at, return_counts=True)
    term, row = np.divmod(met, max(1, len(texts)))
    docs = np.bincount(term, minlength=len(coded.dictionary)).astype(np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(docs)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [coded.dictionary, pa.ListArray.from_arrays(ends, keys.take(pa.array(row))),
         pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())), pa.array(docs)], ["term", "keys", "tfs", "docs"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
        edges = [0, *cuts.tolist(), len(texts)]
        for low, high in zip(edges, edges[1:]):
            if high > low:
                yield _block(keys.slice(low, high - low), texts.slice(low, high - low))


def _postings_schema(key: DataType) -> StructType:
    return (StructType().add("term", StringType()).add("keys", ArrayType(key)).add("tfs", ArrayType(IntegerType()))
            .add("docs", IntegerType()))


def add_documents(documents: DataFrame, path: str, segment: int, text: str = "text", key: str = "doc_id") -> None:
    """Add ``documents`` to the index at ``path`` as one segment; the same segment again replaces it.

    A segment counts once its commit is written, so a failed or running build is not seen. Rows that share a key are one document;
    a null text has no words, rows without a key are left out. A key should be added in one segment only.

    Texts of a key of its own become blocks where they are read. Words of rows that share a key are counted by (key, word)
    first and are blocks of one document.
    """
    spark, order = documents.sparkSession, ["bucket", "term"]
    rows = documents.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    bare = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))
    (rows.groupBy("key").agg(F.sum(words).alias("words"), F.count("*").alias("copies"))
     .write.mode("overwrite").parquet(f"{path}/documents/segment={segment}"))
    known = spark.read.parquet(f"{path}/documents/segment={segment}")
    all_words = known.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    pieces = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS), -(-all_words // (BUCKETS * PIECE_WORDS)))
    schema = _postings_schema(rows.schema["key"].dataType)
    shared = known.filter("copies > 1").select("key")
    if shared.isEmpty():
        blocks = rows.mapInArrow(_blocks, schema)
    else:
        counted = (rows.join(shared, "key", "left_semi").select("key", F.explode(F.split("text", r"\s+")).alias("term"))
                   .filter("term <> ''").groupBy("key", "term").agg(F.count("*").cast("int").alias("tf")))
        blocks = rows.join(shared, "key", "left_anti").mapInArrow(_blocks, schema).union(
            counted.select("term", F.array("key"), F.array("tf"), F.lit(1)))
    # the one exchange of the postings: a task has one piece of one bucket and writes one file
    piece = F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(pieces)).cast("int")
    dealt = blocks.withColumn("bucket", _bucket("term")).repartitionById(BUCKETS * pieces, F.col("bucket") * pieces + piece)
    put = lambda df, name: df.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/segment={segment}")
    put(dealt.sortWithinPartitions(*order), "postings")
    stored = _read(spark, path, "postings", segment, dealt.schema)
    terms = stored.groupBy(*order).agg(F.sum("docs").alias("df"))  # counted before it moves
    put(terms.repartitionByRange(*order).sortWithinPartitions(*order), "terms")  # few files a bucket
    known.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words")).coalesce(
        1).write.mode("overwrite").parquet(f"{path}/commits/segment={segment}")


def _read(spark: SparkSession, path: str, name: str, segment: int, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/segment={segment}")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(segment, n_docs, words) of every finished segment."""
    return spark.read.parquet(f"{path}/commits").select("segment", "n_docs", "words")


def _table(spark: SparkSession, path: str, name: str, schema: StructType, segments: list[int], buckets: list[int]) -> DataFrame:
    """Rows of finished segments in the given buckets; both are folders, so others are not listed for reading.

    The schema is given, so neither a segment without words nor what a dead build left decides it.
    """
    schema = StructType(schema.fields).add("segment", IntegerType()).add("bucket", IntegerType())
    table = spark.read.schema(schema).parquet(f"{path}/{name}").filter(F.col("segment").isin(segments))
    return table.filter(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else table


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, query: str = "query",
                 query_id: str = "query_id") -> DataFrame:
    """(query_id, rank, key, score, terms): the ``k`` best documents of every query, from the index alone.

    Score: sum over the query's distinct words of tf * ln(N / df), N and df over all finished segments; higher first, ties by
    smaller key. Rows that share a query_id are one query. Queries without a known word have no rows.

    Up to ``SENT_WORDS`` query words are sent to the tasks and the postings they need are dealt out by document, once: a
    document's scores for all queries add up where it is, and only its k best candidates per task go on. The parts grow with the
    documents and the queries, as the scores of a part are far more than its postings.
    """
    asked = (queries.select(F.col(query_id).alias("query_id"), F.explode(_words(query)).alias("term")).distinct()
             .withColumn("bucket", _bucket("term")))
    commits = statistics(spark, path).select("segment", "n_docs").collect()  # a row per build
    n_docs, segments = sum(r["n_docs"] for r in commits), [r["segment"] for r in commits]
    sizes = asked.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # at most BUCKETS rows
    buckets = sorted(r["bucket"] for r in sizes)
    wanted = asked.select("bucket", "term").distinct()
    terms = StructType().add("term", StringType()).add("df", LongType())
    idf = (_table(spark, path, "terms", terms, segments, buckets).join(wanted, ["bucket", "term"], "left_semi")
           .groupBy("bucket", "term").agg(F.ln(F.lit(n_docs) / F.sum("df")).alias("idf")))
    key = spark.read.parquet(f"{path}/documents").schema["key"].dataType
    blocks = _table(spark, path, "postings", _postings_schema(key), segments, buckets)
    weighted = asked.join(idf, ["bucket", "term"])
    sent = sum(r["n"] for r in sizes) <= SENT_WORDS
    if sent:
        blocks = blocks.join(F.broadcast(wanted), ["bucket", "term"], "left_semi")
        weighted = F.broadcast(weighted)
    postings = blocks.select("bucket", "term", F.inline(F.arrays_zip("keys", "tfs")).alias("key", "tf"))
    if sent:
        n_queries = asked.agg(F.count_distinct("query_id")).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs * n_queries // TASK_PAIRS))
        postings = postings.repartition(parts, "key")
    scored = postings.join(weighted, ["bucket", "term"]).groupBy("query_id", "key").agg(
        F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("score"), F.count("*").alias("terms"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return (scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "key", "score", "terms"))

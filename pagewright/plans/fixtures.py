"""Derived input views over the given tables, in Spark and in SQL.

Each view is defined twice with integer and string arithmetic only, so that Spark
and the SQL oracle start from equal rows. Definitions are in ``FIXTURES.md``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions.decoding import char_index
from pagewright.functions.text import characters

LINES_PER_PAGE = 49
LINE_STRIDE = 1_000_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The same table as a file stream, be it one file or a folder of part files."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


#: Bytes of a table's files in one part when its rows are dealt out.
PART_BYTES = 512 << 10
#: Groups of a part whose lists are held at once; Spark's own bound is 128.
PART_GROUPS = 1 << 16


def dealt(spark: SparkSession, sf: str, name: str, key: str, *columns: str | Column) -> DataFrame:
    """Columns of a table dealt out by ``key`` before its rows are exploded into many.

    The narrow rows are moved once; what is made of them stays where its key is, so grouping, windows and joins by
    ``key`` and more need no exchange of the many rows. The number of parts grows with the table's files, so that a
    part's rows fit one task's memory, and is ``pagewright.spread`` (``local_session`` sets it to the cores) or else
    the session's shuffle partitions at least. Tables of one key dealt from the same files have equal parts. Joins by
    ``key`` and more leave such parts in place only where the session doesn't ask for all join keys, so that is set. Lists
    are collected by hash, not by sorting rows, for up to ``PART_GROUPS`` groups of a part, as its rows fit its task.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(PART_GROUPS))
    least = int(spark.conf.get("pagewright.spread", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").load(f"{sf}/{name}.parquet")  # lengths only: contents aren't read
    size = files.agg(F.sum("length")).first()[0] or 0
    return table(spark, sf, name).select(key, *columns).repartition(max(least, -(-size // PART_BYTES)), key)


def _texts(spark, sf):
    return dealt(spark, sf, "documents", "doc_id", "text")


def _lines(spark, sf):
    return _texts(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def regions_fx(spark, sf):
    words = _lines(spark, sf).select(
        "doc_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.posexplode(F.split("line", " ")).alias("word_no", "text"),
    ).filter(F.col("text") != "")
    d, l, n = F.col("doc_id"), F.col("line_no"), F.col("word_no")
    return words.select(
        "doc_id",
        (F.floor(l / LINES_PER_PAGE) + 1).cast("int").alias("page_number"),
        (l * LINE_STRIDE + n).alias("region_ord"),
        "text",
        (50 + 60 * n).cast("int").alias("x"),
        (80 + 15 * (l % LINES_PER_PAGE) + (d + n) % 3).cast("int").alias("y"),
        (8 * F.length("text")).cast("int").alias("w"),
        F.lit(12).alias("h"),
        (((d * 31 + l * 17 + n * 7) % 100) / 100.0).cast("double").alias("confidence"),
        (((d * 13 + l * 5 + n * 3) % 100) / 100.0).cast("double").alias("rec_confidence"),
    )


def page_base_fx(spark, sf):
    pages = F.floor((F.size(F.split("text", "\n")) - 1) / LINES_PER_PAGE) + 1
    return dealt(spark, sf, "documents", "doc_id", pages.cast("int").alias("pages")).select(
        "doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page_number")
    )


#: File suffixes by page_id % 9.
SUFFIXES = [".pdf", ".PNG", ".jpg", ".jpeg", ".tiff", ".bmp", ".webp", ".xyz", ".docx"]


def files_fx(spark, sf):
    return files_of(table(spark, sf, "pages"))


def files_of(pages):
    p = F.col("page_id")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (p % 9 + 1).cast("int"))
    return pages.select(
        p.alias("file_id"),
        F.concat(F.lit("/in/f"), F.floor(p / 2).cast("string"), suffix).alias("path"),
        ((p * 7919 % 160) * 1048576 + F.when(p % 3 == 0, 1).otherwise(0)).alias("length"),
        (p * 37 % 4000).cast("int").alias("width"),
        (p * 53 % 4000).cast("int").alias("height"),
        F.when(p % 9 == 0, p % 4).otherwise(1).cast("int").alias("page_count"),
        ((p * 7 % 181 - 90).cast("double") + F.when(p % 2 == 1, 0.25).otherwise(0.0)).alias("angle"),
        (p * 11 % 300).cast("int").alias("n_points"),
    )


def _grid(spark, sf, *extra):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id"), *extra, F.posexplode("embedding").alias("i", "e")
    ).withColumn("e", F.col("e").cast("double"))


def pixels_fx(spark, sf):
    return _grid(spark, sf).select(
        F.col("vec_id").alias("image_id"),
        (F.col("i") % 8).cast("int").alias("x"),
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        F.least(F.greatest(F.floor(128 + 400 * F.col("e")), F.lit(0)), F.lit(255))
        .cast("int").alias("value"),
    )


def cells_fx(spark, sf):
    cells = _grid(spark, sf, "embedding").withColumn(
        "f", F.element_at("embedding", 64 - F.col("i")).cast("double")
    )
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return cells.select(
        F.col("vec_id").alias("page_id"),
        (F.col("i") % 8).cast("int").alias("x"),
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        clamp(0.5 + 4 * F.col("e")).alias("region_score"),
        clamp(0.1 + F.col("f")).alias("affinity_score"),
    )


def logits_fx(spark, sf):
    return _grid(spark, sf).select(
        F.col("vec_id").alias("region_id"),
        F.floor(F.col("i") / 8).cast("int").alias("t"),
        (F.col("i") % 8).cast("int").alias("cls"),
        (F.col("e") * 10).alias("logit"),
    )


def steps_fx(spark, sf):
    chars = _texts(spark, sf).select(
        F.col("doc_id").alias("region_id"),
        F.posexplode(characters("text")).alias("t", "ch"),
    )
    return chars.select(
        "region_id", "t", "ch",
        F.greatest(char_index(F.lower("ch")), F.lit(0)).alias("idx"),
        (((F.col("region_id") * 7 + F.col("t") * 3) % 100) / 100.0).cast("double").alias("prob"),
    )


def step_lengths_fx(spark, sf):
    length = F.greatest(F.length("text") - F.col("doc_id") % 7, F.lit(0)).cast("int").alias("length")
    return dealt(spark, sf, "documents", "doc_id", length).withColumnRenamed("doc_id", "region_id")


def usage_fx(spark, sf):
    return usage_of(table(spark, sf, "events"))


def usage_of(events):
    return events.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("doc_type"),
        (1 + F.col("event_id") % 7).cast("int").alias("pages"),
    )


def licenses_fx(spark, sf):
    r = F.col("c_custkey") % 10
    key = (
        F.when(r == 1, "PRO").when(r == 2, "pro-notadate-SIG").when(r == 3, "PRO-20231231-SIG")
        .when(r == 4, "pro-20240115-SIG").when(r == 5, "gold-20250101-SIG")
        .when(r.isin(6, 7), "PRO-20250101-SIG").when(r.isin(8, 9), "Enterprise-20250101-SIG")
    )
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), key.alias("license_key")
    )


def job_files_fx(spark, sf):
    return job_files_of(table(spark, sf, "events"))


def job_files_of(events):
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type").isin("purchase", "signup", "view"), "completed")
        .otherwise("processing")
    )
    return events.select(
        F.floor(F.col("event_id") / 5).cast("bigint").alias("job_id"),
        F.col("event_id").alias("file_id"), status.alias("file_status"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def invoice_fx(spark, sf):
    o = table(spark, sf, "orders")
    lines = F.array(
        F.concat(F.lit("Order: "), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("Customer: "), F.col("o_custkey").cast("string")),
        F.concat(F.lit("Status: "), F.col("o_orderstatus")),
        F.concat(F.lit("Priority: "), F.col("o_orderpriority")),
        F.lit("Thank you for your business"),
    )
    return o.select("o_orderkey", F.posexplode(lines).alias("line_no", "text")).select(
        F.col("o_orderkey").alias("doc_id"), "line_no", "text",
        (((F.col("o_orderkey") + F.col("line_no")) % 10) / 10.0).cast("double").alias("confidence"),
    )


def grid_fx(spark, sf):
    """Word boxes of a three-column table per order; its rows are the order's lines.

    Lines are dealt out by order and ranked where they lie (see ``ordering.ranked``).
    """
    from pagewright.operators.ordering import ranked

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = dealt(spark, sf, "lineitem", *keys).select(*keys, F.floor(F.col("l_partkey") / 64).alias("_part_band"))
    rows = ranked(li, ["l_orderkey"], ["l_linenumber", "_part_band"],
                  ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "row", together=True)
    cell = lambda n, x, c: F.struct(
        F.lit(n).alias("n"), F.lit(x).alias("x"), c.cast("bigint").cast("string").alias("text"))
    cells = rows.select(
        F.col("l_orderkey").alias("doc_id"), "row",
        F.explode(F.array(
            cell(0, 50, F.col("l_partkey")), cell(1, 150, F.col("l_suppkey")),
            cell(2, 350, F.col("l_quantity")))).alias("c"),
    )
    return cells.select(
        "doc_id", F.lit(1).alias("page_number"),
        (F.col("row") * 3 + F.col("c.n")).alias("region_ord"),
        F.col("c.text").alias("text"), F.col("c.x").alias("x"),
        (80 + 20 * F.col("row")).cast("int").alias("y"),
        F.lit(60).alias("w"), F.lit(12).alias("h"),
    )


#: The same views as SQL common table expressions.
SQL = {
    "doc_lines": """
      SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "regions_fx": """
      SELECT doc_id, CAST(line_no // 49 + 1 AS INTEGER) AS page_number,
             line_no * 1000000000 + word_no AS region_ord, text,
             CAST(50 + 60 * word_no AS INTEGER) AS x,
             CAST(80 + 15 * (line_no % 49) + (doc_id + word_no) % 3 AS INTEGER) AS y,
             CAST(8 * length(text) AS INTEGER) AS w, 12 AS h,
             ((doc_id * 31 + line_no * 17 + word_no * 7) % 100) / 100.0::DOUBLE AS confidence,
             ((doc_id * 13 + line_no * 5 + word_no * 3) % 100) / 100.0::DOUBLE AS rec_confidence,
             line_no
      FROM (SELECT doc_id, line_no, unnest(w) AS text,
                   CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS word_no
            FROM (SELECT doc_id, line_no, string_split(line, ' ') AS w FROM doc_lines))
      WHERE text <> ''""",
    "kept_fx": "SELECT * FROM regions_fx WHERE rec_confidence >= 0.5",
    "page_base_fx": """
      SELECT doc_id, CAST(unnest(range(1, (len(string_split(text, chr(10))) - 1) // 49 + 2)) AS INTEGER)
             AS page_number FROM documents""",
    "line_text_fx": """
      SELECT doc_id, page_number, line_no,
             string_agg(text, ' ' ORDER BY y, x, region_ord) AS line_text
      FROM kept_fx GROUP BY ALL""",
    "page_results_fx": """
      SELECT b.doc_id, b.page_number, coalesce(t.full_text, '') AS full_text,
             coalesce(s.confidence, 0.0) AS confidence, coalesce(s.num_regions, 0) AS num_regions
      FROM page_base_fx b
      LEFT JOIN (SELECT doc_id, page_number, string_agg(line_text, chr(10) ORDER BY line_no) AS full_text
                 FROM line_text_fx GROUP BY ALL) t USING (doc_id, page_number)
      LEFT JOIN (SELECT doc_id, page_number, avg(confidence) AS confidence, count(*) AS num_regions
                 FROM kept_fx GROUP BY ALL) s USING (doc_id, page_number)""",
    "files_fx": """
      SELECT page_id AS file_id,
             '/in/f' || CAST(page_id // 2 AS VARCHAR) ||
             (['.pdf','.PNG','.jpg','.jpeg','.tiff','.bmp','.webp','.xyz','.docx'])[page_id % 9 + 1] AS path,
             (page_id * 7919 % 160) * 1048576 + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS length,
             CAST(page_id * 37 % 4000 AS INTEGER) AS width,
             CAST(page_id * 53 % 4000 AS INTEGER) AS height,
             CAST(CASE WHEN page_id % 9 = 0 THEN page_id % 4 ELSE 1 END AS INTEGER) AS page_count,
             CAST(page_id * 7 % 181 - 90 AS DOUBLE) + CASE WHEN page_id % 2 = 1 THEN 0.25 ELSE 0 END AS angle,
             CAST(page_id * 11 % 300 AS INTEGER) AS n_points,
             lower(regexp_extract('/in/f' ||
               (['.pdf','.PNG','.jpg','.jpeg','.tiff','.bmp','.webp','.xyz','.docx'])[page_id % 9 + 1],
               '[.][a-zA-Z]+$')) AS ext
      FROM pages""",
    "grid64": """
      SELECT vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS i, embedding FROM embeddings""",
    "pixels_fx": """
      SELECT vec_id AS image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
             CAST(least(greatest(floor(128 + 400 * CAST(embedding[i + 1] AS DOUBLE)), 0), 255) AS INTEGER) AS value
      FROM grid64""",
    "cells_fx": """
      SELECT vec_id AS page_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
             least(greatest(0.5::DOUBLE + 4 * CAST(embedding[i + 1] AS DOUBLE), 0), 1) AS region_score,
             least(greatest(0.1::DOUBLE + CAST(embedding[64 - i] AS DOUBLE), 0), 1) AS affinity_score
      FROM grid64""",
    "logits_fx": """
      SELECT vec_id AS region_id, CAST(i // 8 AS INTEGER) AS t, CAST(i % 8 AS INTEGER) AS cls,
             CAST(embedding[i + 1] AS DOUBLE) * 10 AS logit FROM grid64""",
    "steps_fx": """
      SELECT region_id, t, ch,
             CAST(instr('0123456789abcdefghijklmnopqrstuvwxyz', lower(ch)) AS INTEGER) AS idx,
             ((region_id * 7 + t * 3) % 100) / 100.0::DOUBLE AS prob
      FROM (SELECT doc_id AS region_id, unnest(c) AS ch, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS t
            FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE text <> ''))""",
    "step_lengths_fx": """
      SELECT doc_id AS region_id, CAST(greatest(length(text) - doc_id % 7, 0) AS INTEGER) AS length
      FROM documents""",
    "usage_fx": """
      SELECT event_id, user_id, ts, event_type AS doc_type, CAST(1 + event_id % 7 AS INTEGER) AS pages
      FROM events""",
    "licenses_fx": """
      SELECT c_custkey AS user_id,
             CASE c_custkey % 10 WHEN 1 THEN 'PRO' WHEN 2 THEN 'pro-notadate-SIG'
               WHEN 3 THEN 'PRO-20231231-SIG' WHEN 4 THEN 'pro-20240115-SIG'
               WHEN 5 THEN 'gold-20250101-SIG' WHEN 6 THEN 'PRO-20250101-SIG'
               WHEN 7 THEN 'PRO-20250101-SIG' WHEN 8 THEN 'Enterprise-20250101-SIG'
               WHEN 9 THEN 'Enterprise-20250101-SIG' END AS license_key
      FROM customer""",
    "job_files_fx": """
      SELECT event_id // 5 AS job_id, event_id AS file_id,
             CASE WHEN event_type = 'error' THEN 'failed'
                  WHEN event_type IN ('purchase', 'signup', 'view') THEN 'completed'
                  ELSE 'processing' END AS file_status, ts
      FROM events""",
    "grid_rows": """
      SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                l_quantity, l_extendedprice) AS row
      FROM lineitem""",
}

#: Which views each view reads.
_NEEDS = {
    "regions_fx": ["doc_lines"], "kept_fx": ["regions_fx"], "line_text_fx": ["kept_fx"],
    "page_results_fx": ["page_base_fx", "line_text_fx", "kept_fx"],
    "pixels_fx": ["grid64"], "cells_fx": ["grid64"], "logits_fx": ["grid64"],
}


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` preceded by the named views and all they read, each once."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    ctes = ", ".join(f"{name} AS ({SQL[name]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"

"""The pipeline's input tables, read off the supplied star-schema and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text


TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widened(df) if name in TEXT_TABLES else df


def widened(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the scan has fewer parts than that, as a lone small file has.

    A large table has more parts than cores and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Full order of the chunks of a document; the line number alone is not unique.
CHUNK_ORDER = ("document_chunk", "partkey", "speaker", "words", "p_against", "p_favor")


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored chunks: an order is a document, its lines are the chunks.

    Probabilities are whole 64ths, whose sums come out the same in any order.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("document_chunk"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("speaker"),
        F.col("l_quantity").cast("int").alias("words"),
        (F.round(F.col("l_tax") * 100).cast("int") / F.lit(16.0)).alias("p_against"),
        (F.round(F.col("l_discount") * 100).cast("int") * 3 / F.lit(64.0)).alias("p_favor"),
    )
    topics = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"),
        F.col("p_type").alias("policy_area"),
        F.col("p_brand").alias("subtopic_1"),
        F.concat_ws("|", "p_brand", "p_size").alias("subtopic_2"),
    )
    return (
        lines.join(topics, "partkey")
        .withColumn("p_neutral", F.lit(1.0) - F.col("p_against") - F.col("p_favor"))
        .withColumn("chamber", F.when(F.col("speaker") % 2 == 0, "H").otherwise("S"))
    )


CHUNKS_SQL = """
chunks AS (
  SELECT *, 1.0::DOUBLE - p_against - p_favor AS p_neutral,
         CASE WHEN speaker % 2 = 0 THEN 'H' ELSE 'S' END AS chamber
  FROM (SELECT l_orderkey AS document_id, l_linenumber AS document_chunk, l_partkey AS partkey,
               l_suppkey AS speaker, CAST(l_quantity AS INTEGER) AS words,
               CAST(round(l_tax * 100) AS INTEGER) / 16.0::DOUBLE AS p_against,
               CAST(round(l_discount * 100) AS INTEGER) * 3 / 64.0::DOUBLE AS p_favor,
               p_type AS policy_area, p_brand AS subtopic_1,
               p_brand || '|' || CAST(p_size AS VARCHAR) AS subtopic_2
        FROM lineitem JOIN part ON l_partkey = p_partkey))"""
CHUNK_ORDER_SQL = ", ".join(CHUNK_ORDER)


def stance_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance of each speaker on each subtopic, every chunk taken as one document."""
    return (
        chunk_scores(spark, sf_dir)
        .groupBy("speaker", "chamber", "subtopic_1", "subtopic_2")
        .agg(
            F.count("*").alias("document_count"),
            F.sum("words").alias("document_word_count"),
            F.avg("p_against").alias("p_against"),
            F.avg("p_favor").alias("p_favor"),
            F.avg("p_neutral").alias("p_neutral"),
        )
        .withColumn("stance_score", F.col("p_favor") - F.col("p_against"))
        .withColumn("weight", F.col("document_word_count"))
    )


RESULTS_SQL = CHUNKS_SQL + """,
results AS (
  SELECT speaker, chamber, subtopic_1, subtopic_2, count(*) AS document_count,
         CAST(sum(words) AS BIGINT) AS document_word_count, CAST(sum(words) AS BIGINT) AS weight,
         avg(p_against) AS p_against, avg(p_favor) AS p_favor, avg(p_neutral) AS p_neutral,
         avg(p_favor) - avg(p_against) AS stance_score
  FROM chunks GROUP BY ALL)"""


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members: suppliers, several of which share the last name their nation gives them."""
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("speaker")
    )
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(nations, "s_nationkey")
        .select(
            "speaker",
            F.when(key % 2 == 0, "H").otherwise("S").alias("chamber"),
            F.element_at(F.array(F.lit("D"), F.lit("R"), F.lit("I")), (key % 3 + 1).cast("int")).alias("party"),
            key.cast("string").alias("state"),
            key.alias("roster_pos"),
        )
    )


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers as the record prints them: ``Mr. NAME of State``, or without the state."""
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    key = F.col("c_custkey")
    shown = F.when(key % 5 == 0, F.concat(F.lit("Mr. "), "n_name")).otherwise(
        F.concat(F.lit("Ms. "), F.initcap("n_name"), F.lit(" of "), (key % 100).cast("string"))
    )
    shown = F.when(key % 97 == 0, "Mr. RYAN").otherwise(shown)
    return (
        table(spark, sf_dir, "customer")
        .join(nations, "c_nationkey")
        .select(
            key.alias("speaker_id"),
            shown.alias("speaker"),
            F.when(key % 3 == 0, "House").otherwise("senate").alias("chamber"),
            F.col("c_acctbal").alias("ideal_point_mean"),
        )
    )


PEOPLE_SQL = """
roster AS (
  SELECT n_name AS speaker, CASE WHEN s_suppkey % 2 = 0 THEN 'H' ELSE 'S' END AS chamber,
         CASE s_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'I' END AS party,
         CAST(s_suppkey AS VARCHAR) AS state, s_suppkey AS roster_pos
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
speakers AS (
  SELECT c_custkey AS speaker_id,
         CASE WHEN c_custkey % 97 = 0 THEN 'Mr. RYAN'
              WHEN c_custkey % 5 = 0 THEN 'Mr. ' || n_name
              ELSE 'Ms. ' || upper(n_name[1]) || lower(n_name[2:]) || ' of '
                   || CAST(c_custkey % 100 AS VARCHAR) END AS speaker,
         CASE WHEN c_custkey % 3 = 0 THEN 'House' ELSE 'senate' END AS chamber,
         c_acctbal AS ideal_point_mean
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


# Title beginnings and endings that exercise the title normaliser.
TITLE_LEADS = (
    "", "Introduction of the ", "REPORT ON Rule 5, ", "Supporting the introduction of ",
    "Motion to proceed ", "Authorizing the Clerk to amend ", "Providing for consideration of H.R. 1, ",
)
TITLE_TAILS = (
    " Act of 2021", " Act, 2022", " Act; and for other purposes", " Resolution--Continued",
    " ACT (Executive Session).", " act of",
)


def titled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches with a speaker, a policy area and a bill title that needs normalising."""
    lead = F.element_at(F.array(*[F.lit(t) for t in TITLE_LEADS]), (F.col("doc_id") % 7 + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(t) for t in TITLE_TAILS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("speaker"),
        F.col("lang").alias("policy_area"),
        F.col("text").alias("document"),
        "n_chars",
        F.concat(lead, F.lit("Bill  "), (F.col("doc_id") % 300).cast("string"), tail).alias("doc_title"),
    )


def _case(expr: str, values: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


TITLED_SQL = f"""
titled AS (
  SELECT doc_id, source AS speaker, lang AS policy_area, text AS document, n_chars,
         {_case("doc_id % 7", TITLE_LEADS)} || 'Bill  ' || CAST(doc_id % 300 AS VARCHAR)
         || {_case("doc_id % 6", TITLE_TAILS)} AS doc_title
  FROM documents)"""


def bill_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills under their titles: orders, several of one customer sharing a title."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        text.standardize_title(F.concat(F.lit("Bill "), F.col("o_custkey").cast("string"), F.lit(" Act."))).alias("title"),
        F.col("o_orderstatus").alias("bill_type"),
        key.alias("bill_number"),
        F.when(key % 3 != 0, day).alias("summary_date"),
        day.alias("update_date"),
        key.alias("seen"),
    )


ALIASES_SQL = """
aliases AS (
  SELECT 'bill ' || CAST(o_custkey AS VARCHAR) || ' act' AS title, o_orderstatus AS bill_type,
         o_orderkey AS bill_number,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS summary_date,
         CAST(o_orderdate AS DATE) AS update_date, o_orderkey AS seen
  FROM orders),
bills AS (
  SELECT title, bill_type, bill_number, summary_date, update_date FROM (
    SELECT *, row_number() OVER (PARTITION BY title ORDER BY summary_date IS NULL, summary_date DESC,
             CASE WHEN summary_date IS NULL THEN update_date END DESC, seen) AS rn FROM aliases)
  WHERE rn = 1)"""

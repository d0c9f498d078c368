"""Scans, sinks, row filters, counts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import filters, groups, ordering, resolve
from ..plans import fixtures as fx
from ..session import stage_path
from ..sources import tables
from . import query, rounded

SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"


@query("S1 S5", "SELECT * FROM supplier")
def csv_round_trip(spark, sf):
    """Supplier table written as text and read back with its declared schema."""
    path = stage_path(spark, "supplier")
    tables.write_table(fx.table(spark, sf, "supplier"), path, fmt="csv")
    return tables.read_table(spark, path, SUPPLIER, line_breaks=False)


@query("S2 U1", """SELECT year(o_orderdate) AS year, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS custkeys
 FROM orders GROUP BY 1""")
def yearly_files(spark, sf):
    """Orders written as one file set per half of the decade, read as one table."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    early, late = stage_path(spark, "early"), stage_path(spark, "late")
    tables.write_table(orders.where(F.year("day") < 1998), early, fmt="csv")
    tables.write_table(orders.where(F.year("day") >= 1998), late, fmt="csv")
    both = tables.read_many(spark, [early, late], "o_orderkey bigint, o_custkey bigint, day date", line_breaks=False)
    return both.groupBy(F.year("day").alias("year")).agg(
        F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys")
    )


@query("S3", """SELECT 'bill ' || CAST(o_orderkey AS VARCHAR) AS standardized_title, o_orderstatus AS bill_type,
   CAST(o_orderkey AS VARCHAR) AS bill_number, strftime(o_orderdate, '%Y-%m-%d') AS latest_summary_date FROM orders""")
def bill_dictionary(spark, sf):
    value = F.struct(
        F.col("o_orderstatus").alias("bill_type"),
        F.col("o_orderkey").cast("string").alias("bill_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("latest_summary_date"),
    )
    title = F.concat(F.lit("bill "), F.col("o_orderkey").cast("string"))
    js = fx.table(spark, sf, "orders").select(F.to_json(F.create_map(title, value)).alias("value"))
    return tables.bills_from_json(js).select(
        "standardized_title", "bill_type", "bill_number", "latest_summary_date"
    )


@query("S4 A8", f"""WITH {fx.CHUNKS_SQL} SELECT speaker, chamber FROM (
   SELECT source AS speaker, CASE WHEN doc_id % 3 = 0 THEN 'H' ELSE 'S' END AS chamber,
     row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def speaker_chambers(spark, sf):
    df = fx.table(spark, sf, "documents").select(
        F.col("source").alias("speaker"), F.when(F.col("doc_id") % 3 == 0, "H").otherwise("S").alias("chamber"), "doc_id"
    )
    return tables.speaker_chamber(df, "doc_id")


@query("S6 T7", """SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (
   SELECT doc_id, CASE WHEN ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < 0.8
     THEN 'train' ELSE 'test' END AS split FROM documents) GROUP BY 1""")
def random_split_files(spark, sf):
    path = stage_path(spark, "splits")
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    tables.write_splits(groups.random_split(docs, "doc_id"), path)
    back = spark.read.schema("doc_id bigint, source string, split string").parquet(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("S7", f"""WITH {fx.RESULTS_SQL}, s AS (
   SELECT speaker, subtopic_1, avg(stance_score) AS score FROM results GROUP BY ALL)
 SELECT speaker, subtopic_1 AS topic, round(1.3e-11 + score, 9) AS score FROM s""")
def matrix_file(spark, sf):
    """Wide matrix written as text and read back in long form."""
    from ..operators import matrix, pool

    cells = pool.topic_scores(fx.stance_results(spark, sf)).withColumnRenamed("subtopic_1", "topic")
    topics = matrix.topic_list(cells)
    path = stage_path(spark, "matrix")
    tables.write_table(matrix.to_matrix(cells, topics), path, fmt="csv")
    long = tables.read_matrix(spark, path, "speaker", topics, "bigint")
    return long.where(F.col("score").isNotNull()).withColumn("score", rounded("score", 9))


@query("S8", """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN CAST(d.n_chars % 2 AS INTEGER) ELSE l.quality END AS quality,
   l.doc_id IS NULL AS missed FROM documents d LEFT JOIN labels l USING (doc_id)""")
def cached_labels(spark, sf):
    """Document labels: the cached ones, and fresh ones for the keys the cache misses."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    cache = fx.table(spark, sf, "labels").select("doc_id", "quality")
    rows, fresh = tables.with_cache(
        docs, cache, "doc_id", lambda d: d.withColumn("quality", (F.col("n_chars") % 2).cast("int"))
    )
    misses = fresh.select("doc_id", F.lit(True).alias("missed"))
    return rows.join(misses, "doc_id", "left").select(
        "doc_id", "quality", F.coalesce("missed", F.lit(False)).alias("missed")
    )


@query("S9 P8 A14", """WITH m AS (SELECT s_suppkey, upper(n_name) AS speaker,
    CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'S' ELSE 'H' END AS chamber,
    CASE s_suppkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'I' WHEN 3 THEN 'D' END AS party,
    CAST(s_nationkey AS VARCHAR) AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey),
   k AS (SELECT * FROM m WHERE chamber IS NOT NULL AND party IS NOT NULL)
 SELECT * FROM k WHERE speaker IN (SELECT speaker FROM k GROUP BY 1 HAVING count(*) > 1)""")
def members_sharing_names(spark, sf):
    """Roster out of landed member records, then all members whose last name is not unique."""
    key = F.col("s_suppkey")
    chamber = F.element_at(F.array(*[F.lit(c) for c in ("Board", "Senate", "House of Representatives", "House of Representatives")]), (key % 4 + 1).cast("int"))
    party = F.element_at(F.array(*[F.lit(p) for p in ("Democratic", "Republican", "Independent", "Democratic", "None")]), (key % 5 + 1).cast("int"))
    nations = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    record = F.struct(
        F.concat(F.col("n_name"), F.lit(", Ann")).alias("name"),
        party.alias("partyName"),
        F.col("s_nationkey").cast("string").alias("state"),
        F.struct(
            F.array(F.struct(F.lit("Senate").alias("chamber")), F.struct(chamber.alias("chamber"))).alias("item")
        ).alias("terms"),
    )
    landed = fx.table(spark, sf, "supplier").join(nations, "s_nationkey").select("s_suppkey", F.to_json(record).alias("value"))
    members = tables.members_from_json(landed).drop("value")
    return groups.duplicates(members, "speaker").select("s_suppkey", "speaker", "chamber", "party", "state")


SPEAKERS = ("The SPEAKER pro tempore", "Mr. SCHUMER", "the Acting CHAIR", "Ms. BORDEAUX", "The VICE PRESIDENT", "Mr. SABAN")
SPOKEN_SQL = f"""spoken AS (SELECT doc_id, {fx._case("doc_id % 7", SPEAKERS)} AS speaker, n_chars,
   text AS document, source FROM documents)"""


def _spoken(spark, sf):
    names = F.array(*[F.lit(s) for s in SPEAKERS])
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.get(names, (F.col("doc_id") % 7).cast("int")).alias("speaker"), "n_chars",
        F.col("text").alias("document"), "source",
    )


@query("P1 P2", f"""WITH {SPOKEN_SQL} SELECT doc_id, speaker, n_chars FROM spoken WHERE length(document) >= 250
   AND NOT coalesce({" OR ".join(f"starts_with(lower(speaker), '{p}')" for p in fixed.PROCEDURAL_SPEAKERS)}, false)""")
def substantial_speeches(spark, sf):
    df = filters.min_length(filters.drop_prefixes(_spoken(spark, sf), "speaker"), "document")
    return df.select("doc_id", "speaker", "n_chars")


@query("P3 P4 P5", f"""WITH {fx.TITLED_SQL}, t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL
     WHEN doc_id % 13 = 0 THEN doc_title || ' Acting Chair' ELSE doc_title END AS doc_title FROM titled)
 SELECT * FROM t WHERE doc_title IS NOT NULL AND (contains(upper(doc_title), ' ACT') OR contains(upper(doc_title), ' RESOLUTION'))
   AND NOT contains(lower(doc_title), 'acting chair')""")
def bill_speeches(spark, sf):
    title = F.when(F.col("doc_id") % 11 == 0, None).when(
        F.col("doc_id") % 13 == 0, F.concat("doc_title", F.lit(" Acting Chair"))
    ).otherwise(F.col("doc_title"))
    df = fx.titled_documents(spark, sf).select("doc_id", title.alias("doc_title"))
    df = filters.contains_any(filters.require(df, ["doc_title"]), "doc_title")
    return filters.not_contains(df, "doc_title", "acting chair")


@query("P6", """SELECT count(*) AS before, count(l.doc_id) AS after,
   round((count(*) - count(l.doc_id)) * 100 / count(*), 6) AS pct_dropped
 FROM documents d LEFT JOIN labels l USING (doc_id)""")
def unlabelled_dropped(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled"))
    df = fx.table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return filters.drop_report(df, F.col("labelled").isNotNull()).withColumn("pct_dropped", F.round("pct_dropped", 6))


@query("P7", f"""WITH {SPOKEN_SQL} SELECT doc_id, CASE speaker {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.CHUNK_SPEAKER_ALIASES)}
   ELSE speaker END AS speaker,
   CASE speaker {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.DOCUMENT_SPEAKER_ALIASES)} ELSE speaker END AS speaker_whole
 FROM spoken WHERE speaker IS DISTINCT FROM '{fixed.DROPPED_SPEAKER}'""")
def speaker_aliases(spark, sf):
    df = _spoken(spark, sf).select("doc_id", "speaker", F.col("speaker").alias("speaker_whole"))
    df = filters.apply_aliases(df, "speaker", fixed.CHUNK_SPEAKER_ALIASES, fixed.DROPPED_SPEAKER)
    whole = filters.alias_table(spark, fixed.DOCUMENT_SPEAKER_ALIASES)
    return filters.apply_aliases(df, "speaker_whole", whole).select("doc_id", "speaker", "speaker_whole")


@query("P10 P11 P15 P16 P17", """WITH t AS (SELECT doc_id AS document_id, source AS speaker, lang AS policy_area,
    CASE doc_id % 4 WHEN 0 THEN 'Misc.' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE source END AS subtopic_2,
    coalesce(l.quality, -1) AS label FROM documents LEFT JOIN labels l USING (doc_id))
 SELECT document_id, coalesce(CASE WHEN subtopic_2 NOT IN ('', 'Misc.') THEN subtopic_2 END, 'none') AS target,
   subtopic_2 NOT IN ('', 'Misc.') AND subtopic_2 IS NOT NULL AS kept_when_pooling, label <> -1 AS kept_in_report, label
 FROM t""")
def targets(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    topics = F.array(F.lit(fixed.MISC), F.lit(""), F.lit(None), F.col("source"))
    df = filters.fill(
        fx.table(spark, sf, "documents")
        .select("doc_id", F.get(topics, (F.col("doc_id") % 4).cast("int")).alias("subtopic_2"))
        .join(labels, "doc_id", "left"),
        {"label": -1},
    )
    kept = filters.drop_misc(df).select("doc_id", F.lit(True).alias("kept_when_pooling"))
    shown = filters.drop_noise(df).select("doc_id", F.lit(True).alias("kept_in_report"))
    out = filters.fill(
        filters.pick_target(df).join(kept, "doc_id", "left").join(shown, "doc_id", "left"),
        {"target": "none", "kept_when_pooling": False, "kept_in_report": False},
    )
    return out.withColumnsRenamed({"doc_id": "document_id"}).select(
        "document_id", "target", "kept_when_pooling", "kept_in_report", "label"
    )


@query("P14 P8", """SELECT bioguide_id, CASE chamber WHEN 'House' THEN 'H' ELSE 'S' END AS chamber, lastname,
   CASE party_code WHEN 100 THEN 'D' WHEN 200 THEN 'R' WHEN 328 THEN 'I' ELSE 'UNK' END AS party FROM (
   SELECT c_custkey AS bioguide_id, 116 + c_custkey % 2 AS congress, CASE c_custkey % 3 WHEN 0 THEN 'House' WHEN 1 THEN 'Senate' ELSE 'President' END AS chamber,
     c_name AS lastname, CASE c_custkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 328 ELSE 5 END AS party_code FROM customer)
 WHERE congress = 117 AND chamber IN ('House', 'Senate')""")
def external_scores(spark, sf):
    key = F.col("c_custkey")
    raw = fx.table(spark, sf, "customer").select(
        key.alias("bioguide_id"),
        (key % 2 + 116).alias("congress"),
        F.element_at(F.array(F.lit("House"), F.lit("Senate"), F.lit("President")), (key % 3 + 1).cast("int")).alias("chamber"),
        F.concat("c_name", F.lit(", Ann")).alias("bioname"),
        F.element_at(F.array(*[F.lit(c) for c in (100, 200, 328, 5)]), (key % 4 + 1).cast("int")).alias("party_code"),
    )
    return filters.load_scores(raw).select("bioguide_id", "chamber", "lastname", "party")


@query("A9 T2", """SELECT source AS speaker, count(*) FILTER (doc_id % 3 = 0) AS "n_H", count(*) FILTER (doc_id % 3 <> 0) AS "n_S",
   count(*) AS total FROM documents GROUP BY 1 ORDER BY total DESC, speaker LIMIT 5""")
def busiest_speakers(spark, sf):
    df = fx.table(spark, sf, "documents").select(
        F.col("source").alias("speaker"), F.when(F.col("doc_id") % 3 == 0, "H").otherwise("S").alias("chamber")
    )
    counts = groups.count_crosstab(df, "speaker", "chamber", ["H", "S"])
    return groups.top_k(counts, [F.desc("total"), F.asc("speaker")], 5)


@query("A9", """SELECT source AS speaker, count(*) FILTER (doc_id % 3 = 0) AS "n_H", count(*) FILTER (doc_id % 3 <> 0) AS "n_S",
   count(*) AS total FROM documents GROUP BY 1""")
def speaker_crosstab(spark, sf):
    df = fx.table(spark, sf, "documents").select(
        F.col("source").alias("speaker"), F.when(F.col("doc_id") % 3 == 0, "H").otherwise("S").alias("chamber")
    )
    return groups.count_crosstab(df, "speaker", "chamber", ["H", "S"])


@query("A10", f"WITH {fx.PEOPLE_SQL} SELECT chamber, party, count(*) AS count FROM roster GROUP BY ALL")
def roster_counts(spark, sf):
    return groups.group_counts(fx.roster(spark, sf), ["chamber", "party"])


@query("A19 F16", """SELECT bill_type, bill_number, seen FROM (SELECT o_orderstatus AS bill_type, o_custkey AS bill_number,
     o_orderkey AS seen, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY
       coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END, DATE '1900-01-01') DESC, o_orderkey) AS rn
   FROM orders) WHERE rn = 1""")
def latest_summaries(spark, sf):
    key = F.col("o_orderkey")
    df = fx.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("bill_type"), F.col("o_custkey").alias("bill_number"),
        F.when(key % 3 != 0, F.to_date("o_orderdate")).alias("action_date"), key.alias("seen"),
    )
    return resolve.latest_summary(df).select("bill_type", "bill_number", "seen")


@query("A20", """SELECT source, quality AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS pct
 FROM labels JOIN documents USING (doc_id) GROUP BY source, quality
 UNION ALL SELECT 'all', quality, count(*), round(count(*) * 100.0 / sum(count(*)) OVER (), 6) FROM labels GROUP BY quality""")
def label_shares(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    per = groups.label_distribution(labels.join(docs, "doc_id"), "label", ["source"])
    whole = groups.label_distribution(labels, "label").withColumn("source", F.lit("all"))
    return per.unionByName(whole).withColumn("pct", F.round("pct", 6))


@query("A23", "SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf):
    return groups.distinct_values(fx.table(spark, sf, "documents"), "source")


@query("A21", """WITH r AS (SELECT conv_id, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
 g AS (SELECT conv_id, max(CASE WHEN rn = 1 THEN role END) AS a, max(CASE WHEN rn = 2 THEN role END) AS b,
   max(CASE WHEN rn = 3 THEN role END) AS c, count(*) AS n FROM r GROUP BY 1)
 SELECT conv_id, a || ',' || coalesce(b, a) || ',' || coalesce(c, a) AS roles,
   '1,' || (n >= 2)::INT || ',' || (n >= 3)::INT AS valid FROM g""")
def grouped_targets(spark, sf):
    out = groups.group_targets(fx.table(spark, sf, "conversations"), "conv_id", "turn", ["role"])
    return out.select(
        "conv_id", F.array_join("role", ",").alias("roles"),
        F.array_join(F.col("valid").cast("array<string>"), ",").alias("valid"),
    )


@query("T1", "SELECT source, lang, doc_id FROM documents")
def sorted_documents(spark, sf):
    return fx.table(spark, sf, "documents").select("source", "lang", "doc_id").orderBy("source", "lang", "doc_id")


@query("T6", """SELECT doc_id, source FROM (SELECT doc_id, source FROM documents WHERE source <> 'src0'
   ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100)""")
def sampled_documents(spark, sf):
    df = fx.table(spark, sf, "documents").select("doc_id", "source").where("source <> 'src0'")
    return groups.sample_n(df, "doc_id")


@query("T8", """SELECT doc_id, label, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
   WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (
   SELECT doc_id, quality AS label, count(*) OVER (PARTITION BY quality) AS n,
     row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM labels)""")
def stratified_documents(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return groups.stratified_split(labels, "label", "doc_id")


@query("U3 J11", f"""WITH {fx.PEOPLE_SQL} SELECT DISTINCT substr(speaker, instr(speaker, ' ') + 1) AS speaker FROM speakers
 EXCEPT SELECT speaker FROM roster""")
def unmatched_names(spark, sf):
    shown = fx.speakers(spark, sf).select(text.remove_salutation("speaker").alias("speaker"))
    return resolve.missing_names(shown, fx.roster(spark, sf))


@query("U4", """SELECT DISTINCT o_orderkey, unnest(['bill ' || CAST(o_custkey AS VARCHAR) || ' act',
   'bill ' || CAST(o_custkey % 50 AS VARCHAR) || ' act', 'the ' || lower(o_orderstatus)]) AS title FROM orders""")
def bill_titles(spark, sf):
    cust = F.col("o_custkey")
    bills = fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Bill "), cust.cast("string"), F.lit(" Act of 2021")).alias("title"),
        F.array(
            F.concat(F.lit("Introduction of the Bill "), (cust % 50).cast("string"), F.lit(" ACT.")),
            F.concat(F.lit("The  "), "o_orderstatus", F.lit(", 2021")),
            F.lit(None).cast("string"),
        ).alias("alternatives"),
    )
    return resolve.all_titles(bills).select("o_orderkey", "title")


@query("N3 N5", """SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS speaker_id,
   row_number() OVER (ORDER BY -c_acctbal, c_name) - 1 AS position FROM customer""")
def coded_customers(spark, sf):
    """Codes in name order and places in order of falling balance, without a global sort task."""
    df = fx.table(spark, sf, "customer").select("c_name", (-F.col("c_acctbal")).alias("down"))
    codes = ordering.index_keys(df, "c_name", "speaker_id")
    placed = ordering.positions(df, ["down", "c_name"])
    return placed.join(codes, "c_name").select("c_name", "speaker_id", "position")


@query("F19", f"""WITH n AS (SELECT p_type, p_brand, list_sort(list(p_partkey)) AS ids FROM part GROUP BY ALL)
 SELECT p_type, p_brand, unnest(ids) AS doc_id FROM n""")
def exploded_ids(spark, sf):
    """Ids of each node joined into bounded cells, and split back to one row per id."""
    from ..operators import taxonomy

    links = fx.table(spark, sf, "part").select("p_type", "p_brand", F.col("p_partkey").alias("doc_id"))
    return taxonomy.explode_ids(taxonomy.join_ids(links, ["p_type", "p_brand"], "doc_id"), "ids", "doc_id").drop("part")

"""Speeches to bills, speakers to rosters, positions to external records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import resolve
from ..plans import fixtures as fx
from . import query
from .texts import title_sql


@query("A18", f"WITH {fx.ALIASES_SQL} SELECT title, bill_type, bill_number FROM bills")
def resolved_aliases(spark, sf):
    return resolve.resolve_aliases(fx.bill_aliases(spark, sf)).select("title", "bill_type", "bill_number")


@query("J1 J2", f"""WITH {fx.TITLED_SQL}, {title_sql('titled', 'doc_title')}, {fx.ALIASES_SQL},
 details AS (SELECT o_orderstatus AS bill_type, o_orderkey AS bill_number, o_orderpriority AS policy_area FROM orders)
 SELECT s.doc_id, s.standardized_title, b.bill_type, b.bill_number, d.policy_area
 FROM std s LEFT JOIN bills b ON s.standardized_title = b.title
 LEFT JOIN details d ON d.bill_type = b.bill_type AND d.bill_number = b.bill_number""")
def matched_speeches(spark, sf):
    details = fx.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("bill_type"), F.col("o_orderkey").alias("bill_number"),
        F.col("o_orderpriority").alias("policy_area"),
    )
    bills = resolve.enrich(resolve.resolve_aliases(fx.bill_aliases(spark, sf)), details)
    docs = fx.titled_documents(spark, sf).select("doc_id", "doc_title")
    return resolve.match_bills(docs, bills).select(
        "doc_id", "standardized_title", "bill_type", "bill_number", "policy_area"
    )


MATCHED_SQL = f"""{fx.PEOPLE_SQL},
 named AS (SELECT *, upper(left(chamber, 1)) AS code,
   trim(CASE WHEN instr(speaker, '.') > 0 THEN substr(speaker, instr(speaker, '.') + 1) ELSE speaker END) AS name FROM speakers),
 parsed AS (SELECT *, trim(split_part(name, ' of ', 1)) AS lastname,
   CASE WHEN contains(name, ' of ') THEN trim(split_part(name, ' of ', 2)) END AS state FROM named),
 hits AS (SELECT p.speaker_id, count(*) AS n, min(r.party) AS sole,
    arg_min(r.party, r.roster_pos) FILTER (r.state = p.state) AS of_state
   FROM parsed p JOIN roster r ON upper(p.lastname) = upper(r.speaker) AND p.code = r.chamber GROUP BY 1),
 found AS (SELECT p.speaker_id, p.speaker, p.ideal_point_mean, p.lastname, p.state, p.code AS chamber,
   coalesce(CASE WHEN n = 1 THEN sole WHEN n > 1 THEN of_state END, 'UNK') AS party
   FROM parsed p LEFT JOIN hits h USING (speaker_id)),
 matched AS (SELECT speaker_id, speaker, ideal_point_mean, lastname, state,
   CASE WHEN speaker = 'Mr. RYAN' THEN 'H' ELSE chamber END AS chamber,
   CASE WHEN speaker = 'Mr. RYAN' THEN 'D' ELSE party END AS party FROM found)"""


@query("J9 N2", f"WITH {MATCHED_SQL} SELECT speaker_id, speaker, lastname, state, chamber, party FROM matched")
def roster_matches(spark, sf):
    return resolve.match_roster(fx.speakers(spark, sf), fx.roster(spark, sf)).select(
        "speaker_id", "speaker", "lastname", "state", "chamber", "party"
    )


@query("P9 J6", f"""WITH {MATCHED_SQL} SELECT DISTINCT speaker, 'R' AS wanted FROM speakers
   WHERE speaker IN (SELECT speaker FROM matched WHERE party = 'R')
 UNION ALL SELECT DISTINCT speaker, 'X' FROM speakers""")
def party_speakers(spark, sf):
    """Speakers of one party, and all of them for a party nobody has."""
    people = fx.speakers(spark, sf)
    matched = resolve.match_roster(people, fx.roster(spark, sf))
    names = people.select("speaker").distinct()
    one = resolve.filter_party(names, matched, "R").withColumn("wanted", F.lit("R"))
    none = resolve.filter_party(names, matched, "X").withColumn("wanted", F.lit("X"))
    return one.unionByName(none)


SCORES_SQL = """scores AS (SELECT *, chamber AS ch FROM (
   SELECT CASE WHEN s_suppkey % 50 = 0 THEN 'RYAN, Timothy J.' ELSE n_name || ', ' || s_name END AS bioname,
     CASE WHEN s_suppkey % 50 = 0 THEN 'RYAN' ELSE n_name END AS lastname,
     CASE WHEN s_suppkey % 2 = 0 THEN 'H' ELSE 'S' END AS chamber,
     CASE s_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'I' END AS party,
     s_acctbal AS score1, -s_acctbal AS score2, s_suppkey AS external_id, s_suppkey AS score_pos
   FROM supplier JOIN nation ON s_nationkey = n_nationkey))"""

SCORED_SQL = f"""{MATCHED_SQL}, {SCORES_SQL},
 forced AS (SELECT speaker_id, speaker, ideal_point_mean, lastname,
   CASE WHEN speaker = 'Mr. RYAN' THEN 'H' ELSE chamber END AS chamber,
   CASE WHEN speaker = 'Mr. RYAN' THEN 'D' ELSE party END AS party FROM found),
 by_key AS (SELECT upper(lastname) AS k, chamber, party, min(score_pos) AS pos FROM scores GROUP BY ALL),
 by_name AS (SELECT bioname, min(score_pos) AS pos FROM scores GROUP BY ALL),
 linked AS (SELECT f.*, CASE WHEN f.speaker = 'Mr. RYAN' THEN n.pos ELSE b.pos END AS pos FROM forced f
   LEFT JOIN by_key b ON upper(f.lastname) = b.k AND f.chamber = b.chamber AND f.party = b.party
   LEFT JOIN by_name n ON n.bioname = 'RYAN, Timothy J.'),
 scored AS (SELECT l.speaker_id, l.speaker, l.chamber, l.party, l.ideal_point_mean, s.bioname, s.score1, s.score2,
   s.external_id FROM linked l LEFT JOIN scores s ON s.score_pos = l.pos)"""


def external_records(spark, sf):
    key = F.col("s_suppkey")
    nations = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    ryan = key % 50 == 0
    return fx.table(spark, sf, "supplier").join(nations, "s_nationkey").select(
        F.when(ryan, "RYAN, Timothy J.").otherwise(F.concat("n_name", F.lit(", "), "s_name")).alias("bioname"),
        F.when(ryan, "RYAN").otherwise(F.col("n_name")).alias("lastname"),
        F.when(key % 2 == 0, "H").otherwise("S").alias("chamber"),
        F.element_at(F.array(F.lit("D"), F.lit("R"), F.lit("I")), (key % 3 + 1).cast("int")).alias("party"),
        F.col("s_acctbal").alias("score1"),
        (-F.col("s_acctbal")).alias("score2"),
        key.alias("external_id"),
        key.alias("score_pos"),
    )


def scored_speakers(spark, sf):
    """Speakers with the external record they matched, NULL where none did."""
    return resolve.match_scores(fx.speakers(spark, sf), fx.roster(spark, sf), external_records(spark, sf))


@query("J10", f"WITH {SCORED_SQL} SELECT * FROM scored")
def score_matches(spark, sf):
    return scored_speakers(spark, sf).select(
        "speaker_id", "speaker", "chamber", "party", "ideal_point_mean", "bioname", "score1", "score2", "external_id"
    )


@query("J12", f"""SELECT c.conv_id, c.turn, c.role, k.knowledge FROM conversations c LEFT JOIN
   (SELECT role, min(text) AS knowledge FROM conversations WHERE role <> 'system' GROUP BY role) k USING (role)""")
def topic_knowledge(spark, sf):
    conv = fx.table(spark, sf, "conversations")
    wiki = conv.where("role <> 'system'").groupBy(F.col("role").alias("topic")).agg(F.min("text").alias("knowledge"))
    return resolve.add_knowledge(conv.select("conv_id", "turn", "role"), wiki, "role")


@query("J3 P10", """WITH nodes AS (SELECT p_partkey // 2 AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS policy_area,
    p_brand AS subtopic_1, CASE WHEN p_size % 5 = 0 THEN 'Misc.' ELSE CAST(p_size AS VARCHAR) END AS subtopic_2,
    p_partkey AS node_pos FROM part),
 last AS (SELECT doc_id, policy_area, subtopic_1, subtopic_2 FROM (SELECT *, row_number() OVER
    (PARTITION BY doc_id ORDER BY node_pos DESC) AS rn FROM nodes) WHERE rn = 1)
 SELECT d.doc_id, d.lang AS policy_area, l.subtopic_1, l.subtopic_2, nullif(l.subtopic_2, 'Misc.') AS target
 FROM documents d LEFT JOIN last l ON d.doc_id = l.doc_id AND d.lang = l.policy_area""")
def merged_taxonomy(spark, sf):
    from ..operators import filters

    key = F.col("p_partkey")
    nodes = fx.table(spark, sf, "part").select(
        F.floor(key / 2).alias("doc_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (key % 4 + 1).cast("int")).alias("policy_area"),
        F.col("p_brand").alias("subtopic_1"),
        F.when(F.col("p_size") % 5 == 0, fixed.MISC).otherwise(F.col("p_size").cast("string")).alias("subtopic_2"),
        key.alias("node_pos"),
    )
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("policy_area"))
    return filters.pick_target(resolve.merge_taxonomy(docs, nodes)).select(
        "doc_id", "policy_area", "subtopic_1", "subtopic_2", "target"
    )

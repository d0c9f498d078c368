"""Speaker by topic matrices: building, filling, filtering, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups, matrix, pool, resolve
from ..plans import fixtures as fx
from . import query_of_means as query, rounded

CELLS_SQL = f"""{fx.RESULTS_SQL},
 cells AS (SELECT speaker, subtopic_1, subtopic_2 AS topic, subtopic_2, stance_score FROM results),
 parents AS (SELECT speaker, subtopic_1, avg(stance_score) AS stance_score FROM cells GROUP BY ALL),
 children AS (SELECT DISTINCT subtopic_1, subtopic_2 FROM results)"""


def cells(spark, sf):
    """Sparse matrix of speakers and subtopics."""
    return fx.stance_results(spark, sf).select(
        "speaker", "subtopic_1", "subtopic_2", F.col("subtopic_2").alias("topic"),
        "stance_score",
    )


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("W1", f"""WITH {CELLS_SQL}
 SELECT speaker, {", ".join(f'round(max(CASE WHEN subtopic_1 = {chr(39)}{b}{chr(39)} THEN stance_score END), 9) AS "{b}"' for b in BRANDS)}
 FROM parents GROUP BY speaker""")
def wide_matrix(spark, sf):
    scores = pool.topic_scores(cells(spark, sf)).withColumnRenamed("subtopic_1", "topic")
    wide = matrix.to_matrix(scores, BRANDS)
    return wide.select("speaker", *[rounded(F.col(f"`{b}`") + F.lit(0.0), 9).alias(b) for b in BRANDS])


@query("W2", f"""WITH {CELLS_SQL} SELECT speaker, subtopic_1 AS topic, round(stance_score, 9) AS stance_score FROM parents""")
def melted_matrix(spark, sf):
    scores = pool.topic_scores(cells(spark, sf)).withColumnRenamed("subtopic_1", "topic")
    long = matrix.to_long(matrix.to_matrix(scores, BRANDS), ["speaker"], BRANDS)
    return long.withColumn("stance_score", rounded(F.col("stance_score") + F.lit(0.0), 9))


@query("J7 J8", f"""WITH {CELLS_SQL}
, m AS (SELECT subtopic_2, max(subtopic_1) AS subtopic_1 FROM children GROUP BY 1),
 g AS (SELECT p.speaker, m.subtopic_2, p.stance_score AS parent FROM parents p JOIN m USING (subtopic_1)),
 o AS (SELECT speaker, subtopic_2, arg_min(stance_score, subtopic_1) AS own FROM cells GROUP BY ALL)
 SELECT speaker, m.subtopic_1, subtopic_2, round(coalesce(own, parent), 9) AS stance_score, own IS NOT NULL AS observed
 FROM g FULL JOIN o USING (speaker, subtopic_2) JOIN m USING (subtopic_2)""")
def parent_filled_cells(spark, sf):
    own = cells(spark, sf)
    out = matrix.fill_from_parent(own, pool.topic_scores(own), resolve.topic_parents(own))
    return out.withColumn("stance_score", rounded(F.col("stance_score") + F.lit(0.0), 9))


COUNTS_SQL = f"""{CELLS_SQL},
 sc AS (SELECT speaker, count(DISTINCT topic) FILTER (stance_score <> 0) AS n FROM cells GROUP BY 1),
 st AS (SELECT quantile_cont(n, 0.75) AS t FROM sc),
 kept AS (SELECT c.* FROM cells c JOIN sc USING (speaker), st WHERE sc.n >= st.t),
 tc AS (SELECT t.topic, count(DISTINCT speaker) FILTER (stance_score <> 0) AS n
   FROM (SELECT DISTINCT topic FROM cells) t LEFT JOIN kept k ON k.topic = t.topic GROUP BY 1),
 tt AS (SELECT quantile_cont(n, 0.75) AS t FROM tc),
 good AS (SELECT topic FROM tc, tt WHERE n >= t AND n * 1.0 / (SELECT count(DISTINCT speaker) FROM kept) >= 0.1),
 filtered AS (SELECT k.* FROM kept k JOIN good USING (topic))"""


@query("W3 A11 J5 U2", f"WITH {COUNTS_SQL} SELECT speaker, topic, round(stance_score, 9) AS stance_score FROM filtered")
def covered_cells(spark, sf):
    out = matrix.coverage_filter(cells(spark, sf), 0.75, 0.75, 0.1)
    return out.select("speaker", "topic", rounded("stance_score", 9).alias("stance_score"))


@query("W3 A4 A7 M2", f"""WITH {COUNTS_SQL} SELECT speaker, subtopic_1, round(avg(stance_score), 9) AS stance_score, count(*) AS topics
 FROM kept GROUP BY ALL""")
def top_quarter_speaker_scores(spark, sf):
    """Score per speaker and parent topic for speakers in the top quarter by coverage."""
    kept = matrix.coverage_filter(cells(spark, sf), 0.75, 0.0)
    return kept.groupBy("speaker", "subtopic_1").agg(
        rounded(F.avg("stance_score"), 9).alias("stance_score"), F.count("*").alias("topics")
    )


@query("A11 J5", f"WITH {COUNTS_SQL} SELECT speaker, n FROM sc")
def speaker_topic_counts(spark, sf):
    return matrix.coverage_counts(cells(spark, sf), "speaker", "topic")


@query("A12", f"""WITH {COUNTS_SQL}
 SELECT topic, count(DISTINCT speaker) FILTER (stance_score <> 0) AS n,
   round(count(DISTINCT speaker) FILTER (stance_score <> 0) * 1.0 / (SELECT count(DISTINCT speaker) FROM cells), 9) AS coverage
 FROM cells GROUP BY 1""")
def topic_coverage(spark, sf):
    out = matrix.coverage_report(cells(spark, sf), "topic", "speaker")
    return out.withColumn("coverage", rounded("coverage", 9))


@query("A12", f"""WITH {COUNTS_SQL}, r AS (SELECT n * 1.0::DOUBLE / (SELECT count(DISTINCT topic) FROM cells) AS c FROM sc)
 SELECT CAST(count(*) AS BIGINT) AS keys, round(avg(c), 9) AS mean_coverage, round(median(c), 9) AS median_coverage,
   round(stddev_samp(c), 9) AS std_coverage, round((1 - avg(c)) * 100, 6) AS pct_missing FROM r""")
def speaker_coverage_summary(spark, sf):
    out = matrix.coverage_summary(cells(spark, sf), "speaker", "topic")
    names = ("mean_coverage", "median_coverage", "std_coverage")
    return out.withColumns({**{n: rounded(n, 9) for n in names}, "pct_missing": rounded("pct_missing", 6)})


@query("A13", f"""WITH {COUNTS_SQL} SELECT min(n) AS min, max(n) AS max, round(avg(n), 9) AS mean,
   quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q75,
   round(quantile_cont(n, 0.9), 9) AS q90 FROM sc""")
def speaker_count_distribution(spark, sf):
    out = groups.distribution(matrix.coverage_counts(cells(spark, sf), "speaker", "topic"), "n")
    return out.withColumns({"mean": rounded("mean", 9), "q90": rounded("q90", 9)})


@query("J4 U6", f"""WITH {COUNTS_SQL}, ch AS (SELECT speaker, chamber FROM (SELECT speaker, chamber, row_number() OVER
   (PARTITION BY speaker ORDER BY subtopic_2) AS rn FROM results) WHERE rn = 1)
 SELECT DISTINCT speaker, chamber FROM ch WHERE speaker IN (SELECT speaker FROM filtered)""")
def kept_speaker_chambers(spark, sf):
    from ..sources import tables

    kept = matrix.coverage_filter(cells(spark, sf), 0.75, 0.75, 0.1).select("speaker").distinct()
    chambers = tables.speaker_chamber(fx.stance_results(spark, sf), "subtopic_2")
    known = resolve.keep(chambers, kept, ["speaker"])
    return resolve.add_chamber(kept, known)

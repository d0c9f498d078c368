"""Classification, taxonomy and position scores against what they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, groups
from ..plans import fixtures as fx
from ..session import written
from . import query
from .matching import SCORED_SQL, scored_speakers

JUDGED_SQL = """judged AS (SELECT doc_id, l.quality + l.toxic AS truth, CAST(d.n_chars % 3 AS INTEGER) AS pred,
   doc_id % 4 = 0 AS seen FROM documents d LEFT JOIN labels l USING (doc_id))"""


def judged(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("truth"))
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 3).cast("int").alias("pred"), (F.col("doc_id") % 4 == 0).alias("seen")
    )
    return docs.join(labels, "doc_id", "left")


def report_sql(source: str, by: str = "") -> str:
    """CTEs ending in ``report``: precision, recall and F1 per class of ``source``."""
    b = f"{by}, " if by else ""
    return f"""known AS (SELECT * FROM {source} WHERE truth IS NOT NULL AND truth <> -1),
      sides AS (SELECT {b} truth AS class, 1 AS t, 0 AS p, (truth = pred)::INT AS h FROM known
                UNION ALL SELECT {b} pred, 0, 1, 0 FROM known),
      sums AS (SELECT {b} class, CAST(sum(t) AS BIGINT) AS t, CAST(sum(p) AS BIGINT) AS p, CAST(sum(h) AS BIGINT) AS h FROM sides GROUP BY ALL),
      report AS (SELECT {b} class, t AS support, coalesce(h * 1.0::DOUBLE / nullif(p, 0), 0) AS precision,
        coalesce(h * 1.0::DOUBLE / nullif(t, 0), 0) AS recall, coalesce(2.0::DOUBLE * h / nullif(p + t, 0), 0) AS f1 FROM sums)"""


@query("E1", f"""WITH {JUDGED_SQL}, {report_sql("judged")}
 SELECT CAST(class AS VARCHAR) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM report
 UNION ALL SELECT 'macro', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9) FROM report""")
def class_report(spark, sf):
    report = evaluate.classification_report(judged(spark, sf)).withColumn("class", F.col("class").cast("string"))
    both = report.drop("support").unionByName(evaluate.macro(report).withColumn("class", F.lit("macro")))
    return both.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("E2", f"""WITH {JUDGED_SQL}, tagged AS (SELECT *, 'all' AS subset FROM judged UNION ALL
   SELECT *, CASE WHEN seen THEN 'few_shot' ELSE 'zero_shot' END FROM judged), {report_sql("tagged", "subset")}
 SELECT subset, round(avg(f1), 9) AS f1 FROM report GROUP BY 1""")
def f1_by_subset(spark, sf):
    return evaluate.f1_by_flag(judged(spark, sf), "seen").withColumn("f1", F.round("f1", 9))


@query("E3 A21", f"""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
   length(role) % 3 AS truth, length(text) % 3 AS pred, turn % 2 AS few FROM conversations),
 cells AS (SELECT rn - 1 AS place, truth, pred, few FROM r WHERE rn <= 3),
 tagged AS (SELECT *, 'all' AS subset FROM cells UNION ALL
   SELECT *, CASE WHEN few = 1 THEN 'few_shot' ELSE 'zero_shot' END FROM cells),
 {report_sql("tagged", "subset, place")}, m AS (SELECT subset, place, avg(f1) AS f1 FROM report GROUP BY ALL)
 SELECT subset, round(sum(f1) / CASE subset WHEN 'all' THEN count(*) ELSE 3 END, 9) AS f1 FROM m GROUP BY subset""")
def multi_target_scores(spark, sf):
    conv = fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.length("role") % 3).alias("truth"), (F.length("text") % 3).alias("pred"),
        (F.col("turn") % 2).alias("few"),
    )
    grouped = groups.group_targets(conv, "conv_id", "turn", ["truth", "pred", "few"])
    return evaluate.multi_target_f1(grouped).withColumn("f1", F.round("f1", 9))


def gold_docs(spark, sf, field):
    """Documents with a JSON list of gold names: the distinct brands or kinds of an order's parts."""
    names = F.transform(F.array_sort(F.collect_set(field)), lambda n: F.struct(n.alias("name")))
    docs = fx.chunk_scores(spark, sf).groupBy(F.col("document_id").alias("doc_id")).agg(F.to_json(names).alias("names"))
    return docs.withColumn(
        "policy_area", F.when(F.col("doc_id") % 50 == 0, None).when(F.col("doc_id") % 2 == 0, "Health").otherwise("Taxes")
    )


def generated(spark, sf):
    """One generated label per document: the kind of its first part; none for every tenth document."""
    first = fx.chunk_scores(spark, sf).groupBy(F.col("document_id").alias("doc_id")).agg(
        F.min_by("policy_area", F.struct(*fx.CHUNK_ORDER)).alias("label")
    )
    return first.where(F.col("doc_id") % 10 != 3)


GOLD_AREA = "CASE WHEN document_id % 50 = 0 THEN NULL WHEN document_id % 2 = 0 THEN 'Health' ELSE 'Taxes' END"


def gold_sql(field: str) -> str:
    return f"""{fx.CHUNKS_SQL},
     docs AS (SELECT document_id AS doc_id, {GOLD_AREA} AS policy_area FROM chunks GROUP BY document_id),
     gold AS (SELECT DISTINCT document_id AS doc_id, {GOLD_AREA} || '_' || {field} AS gold FROM chunks
              WHERE {GOLD_AREA} IS NOT NULL),
     gen AS (SELECT document_id AS doc_id, label FROM (SELECT document_id, policy_area AS label, row_number() OVER
       (PARTITION BY document_id ORDER BY {fx.CHUNK_ORDER_SQL}) AS rn FROM chunks) WHERE rn = 1 AND document_id % 10 <> 3)"""


@query("E4 F17", f"WITH {gold_sql('subtopic_1')} SELECT doc_id, gold FROM gold")
def gold_label_rows(spark, sf):
    return evaluate.gold_labels(gold_docs(spark, sf, "subtopic_1"), "names")


# Brute force over all pairs of documents, gold labels as bits.
PAIRS_SQL = """codes AS (SELECT gold, row_number() OVER (ORDER BY gold) - 1 AS bit FROM (SELECT DISTINCT gold FROM gold)),
   masks AS (SELECT doc_id, CAST(sum(1::BIGINT << CAST(bit AS INT)) AS BIGINT) AS mask FROM gold JOIN codes USING (gold) GROUP BY 1),
   joint AS (SELECT m.doc_id, mask, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS g FROM masks m JOIN gen USING (doc_id)),
   pairs AS (SELECT count(*) FILTER (a.g = b.g AND (a.mask & b.mask) <> 0) AS tp,
       count(*) FILTER (a.g = b.g AND (a.mask & b.mask) = 0) AS fp,
       count(*) FILTER (a.g <> b.g AND (a.mask & b.mask) <> 0) AS fn0
     FROM joint a JOIN joint b ON a.doc_id < b.doc_id),
   pairwise AS (SELECT tp, fp, fn0 + (SELECT count(DISTINCT doc_id) FROM gold WHERE doc_id NOT IN (SELECT doc_id FROM gen)) AS fn FROM pairs),
   prf AS (SELECT *, tp * 1.0::DOUBLE / (tp + fp) AS p, tp * 1.0::DOUBLE / (tp + fn) AS r FROM pairwise)"""


@query("E5 J13", f"""WITH {gold_sql('subtopic_1')}, {PAIRS_SQL}
 SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, round(p, 9) AS precision, round(r, 9) AS recall,
        round(2 * p * r / (p + r), 9) AS f1 FROM prf""")
def pairwise_agreement(spark, sf):
    gold = evaluate.gold_labels(gold_docs(spark, sf, "subtopic_1"), "names")
    out = evaluate.pairwise_metrics(gold, generated(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


AMI_SQL = """lp AS (SELECT gold AS a, label AS b FROM gold JOIN gen USING (doc_id)),
   total AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM lp),
   ra AS (SELECT a, count(*) AS n FROM lp GROUP BY 1), rb AS (SELECT b, count(*) AS n FROM lp GROUP BY 1),
   mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM (SELECT c.n, ra.n::DOUBLE AS na, rb.n::DOUBLE AS nb FROM
     (SELECT a, b, count(*) AS n FROM lp GROUP BY 1, 2) c JOIN ra USING (a) JOIN rb USING (b)), total),
   ha AS (SELECT -sum(n / t * ln(n / t)) AS h FROM ra, total), hb AS (SELECT -sum(n / t * ln(n / t)) AS h FROM rb, total),
   sa AS (SELECT n AS x, count(*) AS k FROM ra GROUP BY 1), sb AS (SELECT n AS y, count(*) AS k FROM rb GROUP BY 1),
   terms AS (SELECT x, y, sa.k * sb.k AS k, t, unnest(range(CAST(greatest(1, x + y - t) AS BIGINT), least(x, y) + 1)) AS n FROM sa, sb, total),
   emi AS (SELECT sum(k * n / t * ln(t * n / (x::DOUBLE * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1)
      - lgamma(t + 1) - lgamma(n + 1) - lgamma(x - n + 1) - lgamma(y - n + 1) - lgamma(t - x - y + n + 1))) AS emi FROM terms),
   amis AS (SELECT mi, ha.h AS h_a, hb.h AS h_b, emi, (mi - emi) / ((ha.h + hb.h) / 2 - emi) AS ami FROM mi, ha, hb, emi)"""


@query("E6", f"""WITH {gold_sql('subtopic_1')}, {AMI_SQL} SELECT round(mi, 6) AS mi, round(h_a, 6) AS h_a, round(h_b, 6) AS h_b,
   round(emi, 6) AS expected_mi, round(ami, 5) AS ami FROM amis""")
def adjusted_mutual_information(spark, sf):
    gold = evaluate.gold_labels(gold_docs(spark, sf, "subtopic_1"), "names")
    out = evaluate.ami(evaluate.label_pairs(gold, generated(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mi", "h_a", "h_b", "expected_mi")], F.round("ami", 5).alias("ami"))


COVER_SQL = """gd AS (SELECT DISTINCT doc_id FROM docs WHERE policy_area IS NOT NULL),
   cover AS (SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM gen) AS labelled, count(*) AS gold_documents,
     count(g.doc_id) AS common, count(*) - count(g.doc_id) AS missing FROM gd LEFT JOIN gen g USING (doc_id))"""


@query("E7 U5", f"""WITH {gold_sql('subtopic_1')}, {COVER_SQL}
 SELECT *, round(labelled * 100.0 / documents, 6) AS pct_labelled, round(missing * 100.0 / documents, 6) AS pct_missing,
   round(common * 1.0 / gold_documents, 9) AS coverage FROM cover""")
def label_coverage(spark, sf):
    docs = gold_docs(spark, sf, "subtopic_1")
    out = evaluate.taxonomy_coverage(docs, evaluate.gold_labels(docs, "names"), generated(spark, sf))
    return out.withColumns(
        {"pct_labelled": F.round("pct_labelled", 6), "pct_missing": F.round("pct_missing", 6), "coverage": F.round("coverage", 9)}
    )


def _metric_sql(field: str, source: str) -> str:
    return f"""(WITH {gold_sql(field)}, {PAIRS_SQL}, {AMI_SQL}, {COVER_SQL},
      c AS (SELECT p, r, ami, common * 1.0::DOUBLE / gold_documents AS coverage FROM prf, amis, cover)
      SELECT '{source}' AS source, unnest(['Pairwise Precision', 'Pairwise Recall', 'Pairwise F1', 'AMI', 'Coverage', 'Coverage-Adjusted AMI']) AS metric,
        unnest([p, r, 2 * p * r / (p + r), ami, coverage, ami * coverage]) AS value FROM c)"""


@query("E8", f"""SELECT metric, round(max(CASE WHEN source = 'subjects' THEN value END), 5) AS subjects,
   round(max(CASE WHEN source = 'committees' THEN value END), 5) AS committees
 FROM ({_metric_sql("subtopic_1", "subjects")} UNION ALL {_metric_sql("policy_area", "committees")}) GROUP BY metric""")
def taxonomy_metric_table(spark, sf):
    gen = written(generated(spark, sf), "generated")
    parts = []
    for field, source in (("subtopic_1", "subjects"), ("policy_area", "committees")):
        docs = gold_docs(spark, sf, field)
        parts.append(evaluate.taxonomy_metrics(docs, evaluate.gold_labels(docs, "names"), gen, source))
    out = evaluate.metric_table(parts[0].unionByName(parts[1]), ["subjects", "committees"])
    return out.select("metric", F.round("subjects", 5).alias("subjects"), F.round("committees", 5).alias("committees"))


TAGGED_SQL = f"""{SCORED_SQL}, good AS (SELECT * FROM scored WHERE bioname IS NOT NULL),
 tagged AS (SELECT *, unnest(['Overall', CASE party WHEN 'D' THEN 'Democrats' WHEN 'R' THEN 'Republicans' END,
   CASE chamber WHEN 'H' THEN 'House' WHEN 'S' THEN 'Senate' END]) AS tag FROM good),
 ranked AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n,
   rank() OVER (PARTITION BY tag ORDER BY ideal_point_mean) + (count(*) OVER (PARTITION BY tag, ideal_point_mean) - 1) / 2.0::DOUBLE AS x_rank,
   rank() OVER (PARTITION BY tag ORDER BY score1) + (count(*) OVER (PARTITION BY tag, score1) - 1) / 2.0::DOUBLE AS y_rank
   FROM tagged WHERE tag IS NOT NULL),
 shifts AS (SELECT *, abs(x_rank - y_rank) AS rank_diff FROM ranked WHERE n >= 10)"""

X, Y = "ideal_point_mean", "score1"


def tagged_scores(spark, sf):
    scored = scored_speakers(spark, sf).where(F.col("bioname").isNotNull())
    return evaluate.tagged(scored)


def _p_sql(r: str) -> str:
    """p-value by the midpoint rule, in 100000 steps on each side."""
    f = "power(sin(hi * (i + 0.5) / 100000), n - 3) * hi / 100000"
    return f"""angles AS (SELECT tag, n, {r} AS r, acos(abs({r})) AS hi, 0 AS part FROM base
        UNION ALL SELECT tag, n, {r}, pi() / 2, 1 FROM base),
      sums AS (SELECT tag, n, r, part, sum({f}) AS v FROM angles, range(100000) t(i) GROUP BY ALL)
      SELECT tag, n, round(r, 9) AS r, round(sum(v) FILTER (part = 0) / sum(v) FILTER (part = 1), 6) AS p FROM sums GROUP BY tag, n, r"""


@query("E9 E11", f"""WITH {TAGGED_SQL}, base AS (SELECT tag, count(*) AS n, corr({X}, {Y}) AS r FROM ranked GROUP BY 1 HAVING count(*) > 5),
 {_p_sql("r")}""")
def pearson_by_filter(spark, sf):
    out = evaluate.pearson_by(tagged_scores(spark, sf), ["tag"], X, Y)
    return out.withColumns({"r": F.round("r", 9), "p": F.round("p", 6)})


@query("E10 N1", f"""WITH {TAGGED_SQL}, base AS (SELECT tag, count(*) AS n, corr(x_rank, y_rank) AS r FROM ranked GROUP BY 1 HAVING count(*) > 5),
 {_p_sql("r")}""")
def spearman_by_filter(spark, sf):
    out = evaluate.spearman_by(tagged_scores(spark, sf), ["tag"], X, Y)
    return out.withColumns({"r": F.round("r", 9), "p": F.round("p", 6)})


def shifts(spark, sf):
    tagged = evaluate.large_enough(tagged_scores(spark, sf), ["tag"], 10)
    return evaluate.rank_shift(tagged, ["tag"], X, Y)


@query("N1 E11", f"""WITH {TAGGED_SQL} SELECT tag, speaker_id, x_rank, y_rank, rank_diff,
   round(100.0::DOUBLE * rank_diff / n, 9) AS rank_shift_pct FROM shifts""")
def rank_shifts(spark, sf):
    return shifts(spark, sf).select(
        "tag", "speaker_id", "x_rank", "y_rank", "rank_diff", F.round("rank_shift_pct", 9).alias("rank_shift_pct")
    )


TITLE_CASE = "array_to_string(list_transform(string_split(replace(bioname, ',', ', '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("T4 M14 F11", f"""WITH {TAGGED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY rank_diff DESC, speaker_id) AS rank FROM shifts)
 SELECT tag, rank, {TITLE_CASE} AS name, party, chamber, CAST(trunc(x_rank) AS INTEGER) AS position_rank,
   CAST(trunc(y_rank) AS INTEGER) AS external_rank, CAST(trunc(rank_diff) AS INTEGER) AS rank_diff,
   round(100.0::DOUBLE * t.rank_diff / n + 1e-9, 1) AS shift_pct FROM t WHERE rank <= 10""")
def largest_rank_shifts(spark, sf):
    return evaluate.top_shifts(shifts(spark, sf), ["tag"], "speaker_id")


@query("E12", f"""WITH {TAGGED_SQL} SELECT tag, n, round(avg(rank_diff), 9) AS mean_shift, median(rank_diff) AS median_shift,
   round(100 * avg(rank_diff) / n, 9) AS mean_shift_pct, round(100 * median(rank_diff) / n, 9) AS median_shift_pct
 FROM shifts GROUP BY tag, n""")
def rank_shift_summary(spark, sf):
    out = evaluate.shift_summary(shifts(spark, sf), ["tag"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean_shift", "mean_shift_pct", "median_shift_pct")})


@query("E13 E11", f"""WITH {TAGGED_SQL} SELECT tag, round(regr_slope({Y}, {X}), 9) AS slope, round(regr_intercept({Y}, {X}), 5) AS intercept,
   count(*) AS n FROM ranked GROUP BY tag HAVING count(*) >= 5""")
def fitted_lines(spark, sf):
    out = evaluate.fit_line(tagged_scores(spark, sf), ["tag"], X, Y)
    return out.withColumns({"slope": F.round("slope", 9), "intercept": F.round("intercept", 5)})


@query("T5", f"""WITH {TAGGED_SQL} SELECT arg_min(bioname, ({X}, speaker_id)) AS "min_{X}", arg_min(bioname, (-{X}, speaker_id)) AS "max_{X}",
   arg_min(bioname, ({Y}, speaker_id)) AS "min_{Y}", arg_min(bioname, (-{Y}, speaker_id)) AS "max_{Y}" FROM good""")
def extreme_speakers(spark, sf):
    scored = scored_speakers(spark, sf).where(F.col("bioname").isNotNull())
    return groups.extremes(scored, "bioname", [X, Y], "speaker_id")


@query("E14", """SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS target, CAST(d.n_chars % 2 AS VARCHAR) AS generated,
   l.quality = d.n_chars % 2 AS agrees FROM documents d JOIN labels l USING (doc_id)""")
def target_and_generated(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("target"))
    docs = fx.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("string").alias("generated"))
    return evaluate.exact_match(labels.join(docs, "doc_id"), "target", "generated")

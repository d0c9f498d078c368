"""Stance arithmetic and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stance
from ..operators import pool
from ..plans import fixtures as fx
from . import query_of_means as query, rounded

ORDER = fx.CHUNK_ORDER_SQL
PROB_SQL = "p_against, p_favor, p_neutral"
MAXP = "greatest(p_against, p_favor, p_neutral)"
ROUNDED_SQL = "round(p_against, 9) AS p_against, round(p_favor, 9) AS p_favor, round(p_neutral, 9) AS p_neutral"


def _argmax_sql(a="p_against", f="p_favor", n="p_neutral") -> str:
    return f"CASE WHEN {a} >= {f} AND {a} >= {n} THEN 0 WHEN {f} >= {n} THEN 1 ELSE 2 END"


def _rounded(df, *names, digits=9):
    return df.withColumns({n: rounded(F.col(n) + F.lit(0.0), digits) for n in names})


PROBS = stance.PROBS
KEYS = ("document_id", "document_chunk", "partkey", "speaker", "words")
KEYS_SQL = ", ".join(KEYS)


@query("M1", f"""WITH {fx.CHUNKS_SQL}, l AS (
  SELECT *, p_against * 4 AS x, p_favor * 4 AS y, p_neutral * 4 AS z FROM chunks),
 e AS (SELECT *, exp(x - greatest(x, y, z)) AS ea, exp(y - greatest(x, y, z)) AS ef,
              exp(z - greatest(x, y, z)) AS en FROM l)
 SELECT {KEYS_SQL}, round(ea / (ea + ef + en), 9) AS against, round(ef / (ea + ef + en), 9) AS favor,
        round(en / (ea + ef + en), 9) AS neutral FROM e""")
def softmax_logits(spark, sf):
    df = fx.chunk_scores(spark, sf)
    a, f, n = stance.softmax([F.col(p) * 4 for p in PROBS])
    return df.select(*KEYS, rounded(a, 9).alias("against"), rounded(f, 9).alias("favor"), rounded(n, 9).alias("neutral"))


@query("M2 M3 M4 P13", f"""WITH {fx.CHUNKS_SQL}
 SELECT {KEYS_SQL}, round(p_favor - p_against, 9) AS score, round(abs(p_favor - p_against), 9) AS sure,
        round({MAXP}, 9) AS class_sure, {_argmax_sql()} AS class_index,
        CASE {_argmax_sql()} WHEN 0 THEN 'against' WHEN 1 THEN 'favor' ELSE 'neutral' END AS stance,
        CASE {_argmax_sql()} WHEN 0 THEN 'AGAINST' WHEN 1 THEN 'FAVOR' ELSE 'NONE' END AS stance_upper
 FROM chunks""")
def chunk_stances(spark, sf):
    top = stance.argmax()
    return fx.chunk_scores(spark, sf).select(
        *KEYS,
        rounded(stance.stance_score() + F.lit(0.0), 9).alias("score"),
        rounded(stance.confidence("score"), 9).alias("sure"),
        rounded(stance.confidence("class"), 9).alias("class_sure"),
        top.alias("class_index"),
        stance.stance_label(top).alias("stance"),
        stance.stance_label(top, stance.fixed.STANCES_UPPER).alias("stance_upper"),
    )


def _weight_sql(cols: list[str]) -> str:
    terms = " + ".join(f"({c}) * ln(({c}) + 1e-10)" for c in cols)
    return f"1 + ({terms}) / ln({len(cols)})"


@query("M5 M6", f"""WITH {fx.CHUNKS_SQL}, b AS (
   SELECT *, p_against / (p_against + p_favor + 1e-10) AS ba, p_favor / (p_against + p_favor + 1e-10) AS bf
   FROM chunks)
 SELECT {KEYS_SQL}, round({_weight_sql(["p_against", "p_favor", "p_neutral"])}, 8) AS w_entropy,
        round({MAXP}, 8) AS w_max, round({_weight_sql(["ba", "bf"])}, 8) AS w_entropy_binary,
        round(greatest(ba, bf), 8) AS w_max_binary
 FROM b""")
def prediction_weights(spark, sf):
    df = fx.chunk_scores(spark, sf)
    w = stance.prediction_weight
    return df.select(
        *KEYS,
        rounded(w(), 8).alias("w_entropy"),
        rounded(w(method="max_prob"), 8).alias("w_max"),
        rounded(w(binary=True), 8).alias("w_entropy_binary"),
        rounded(w(method="max_prob", binary=True), 8).alias("w_max_binary"),
    )


@query("M7", f"""WITH {fx.CHUNKS_SQL}, r AS (
   SELECT *, p_favor - p_against AS s,
     abs(p_favor - p_against) < 0.1 AND p_neutral > greatest(p_against, p_favor) AS neutral FROM chunks)
 SELECT {KEYS_SQL}, round(s, 9) AS score,
        CASE WHEN neutral THEN 2 WHEN s > 0 THEN 1 ELSE 0 END AS stance,
        round(CASE WHEN neutral THEN p_neutral WHEN s > 0 THEN p_favor ELSE p_against END, 9) AS sure
 FROM r""")
def rule_stances(spark, sf):
    rule = stance.rule_stance()
    return fx.chunk_scores(spark, sf).select(
        *KEYS,
        rounded(rule["score"] + F.lit(0.0), 9).alias("score"),
        rule["stance"].alias("stance"),
        rounded(rule["confidence"], 9).alias("sure"),
    )


@query("M8", f"""WITH {fx.CHUNKS_SQL}
 SELECT speaker, subtopic_1, round(abs(
     sum(words * p_against / (p_against + p_favor + 1e-10)) / sum(words)
   - sum(words * p_favor / (p_against + p_favor + 1e-10)) / sum(words)), 8) AS confidence
 FROM chunks GROUP BY ALL""")
def weighted_binary_confidence(spark, sf):
    out = pool.weighted_confidence(fx.chunk_scores(spark, sf), ["speaker", "subtopic_1"], "words")
    return _rounded(out, "confidence", digits=8)


META_SQL = "speaker, chamber, subtopic_1, subtopic_2"
FIRST_SQL = f"""first AS (SELECT document_id, {META_SQL} FROM (SELECT *, row_number() OVER
   (PARTITION BY document_id ORDER BY {ORDER}) AS rn FROM chunks) WHERE rn = 1)"""


def _docs_sql(method: str) -> str:
    """CTEs ending in ``docs``: chunks pooled to documents."""
    if method == "max":
        pooled = f"""pooled AS (SELECT document_id, {PROB_SQL}, document_chunk AS top_chunk FROM (
            SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {MAXP} DESC, {ORDER}) AS rn
            FROM chunks) WHERE rn = 1)"""
    else:
        def mean(p: str) -> str:
            if method == "mean":
                return f"avg({p}) AS {p}"
            return f"coalesce(sum(words * {p}) / nullif(sum(words), 0), avg({p})) AS {p}"

        pooled = f"""means AS (SELECT document_id, {mean("p_against")}, {mean("p_favor")}, {mean("p_neutral")}
            FROM chunks GROUP BY document_id),
          won AS (SELECT m.*, {_argmax_sql()} AS k FROM means m),
          pooled AS (SELECT document_id, {PROB_SQL}, top_chunk FROM (
            SELECT w.*, c.document_chunk AS top_chunk, row_number() OVER (PARTITION BY w.document_id ORDER BY
              CASE k WHEN 0 THEN c.p_against WHEN 1 THEN c.p_favor ELSE c.p_neutral END DESC,
              c.document_chunk, c.partkey, c.speaker, c.words, c.p_against, c.p_favor) AS rn
            FROM won w JOIN chunks c USING (document_id)) WHERE rn = 1)"""
    return f"""{fx.CHUNKS_SQL}, {FIRST_SQL}, {pooled},
      sizes AS (SELECT document_id, CAST(sum(words) AS BIGINT) AS words, count(*) AS chunks
                FROM chunks GROUP BY document_id),
      docs AS (SELECT * FROM first JOIN pooled USING (document_id) JOIN sizes USING (document_id))"""


def _pooled_docs(spark, sf, method):
    return pool.pool_chunks(fx.chunk_scores(spark, sf), method, order=fx.CHUNK_ORDER)


def _docs_query(method: str) -> str:
    return f"""WITH {_docs_sql(method)} SELECT document_id, {META_SQL}, {ROUNDED_SQL}, words, chunks, top_chunk
      FROM docs"""


@query("A1 A5", _docs_query("max"))
def pool_chunks_max(spark, sf):
    return _rounded(_pooled_docs(spark, sf, "max"), *PROBS)


@query("A2 A5", _docs_query("mean"))
def pool_chunks_mean(spark, sf):
    return _rounded(_pooled_docs(spark, sf, "mean"), *PROBS)


@query("A3 A5", _docs_query("weighted"))
def pool_chunks_weighted(spark, sf):
    return _rounded(_pooled_docs(spark, sf, "weighted"), *PROBS)


def _topics_query(method: str) -> str:
    """Documents pooled once more, to speakers and subtopics."""
    head = f"""{_docs_sql(method)},
      meta AS (SELECT speaker, subtopic_2, chamber, subtopic_1 FROM (SELECT *, row_number() OVER
        (PARTITION BY speaker, subtopic_2 ORDER BY document_id) AS rn FROM docs) WHERE rn = 1),
      totals AS (SELECT speaker, subtopic_2, count(*) AS documents_total,
        CAST(sum(words) AS BIGINT) AS document_word_count FROM docs GROUP BY ALL)"""
    if method == "max":
        best = f"""best AS (SELECT speaker, subtopic_2, {PROB_SQL}, document_id AS most_important_doc,
            CAST(1 AS BIGINT) AS document_count FROM (
            SELECT *, row_number() OVER (PARTITION BY speaker, subtopic_2 ORDER BY {MAXP} DESC, document_id) AS rn
            FROM docs) WHERE rn = 1)"""
    else:
        def mean(p: str) -> str:
            if method == "mean":
                return f"avg({p}) AS {p}"
            return f"coalesce(sum(words * {p}) / nullif(sum(words), 0), avg({p})) AS {p}"

        best = f"""tmeans AS (SELECT speaker, subtopic_2, {mean("p_against")}, {mean("p_favor")},
            {mean("p_neutral")}, count(*) AS document_count FROM docs GROUP BY speaker, subtopic_2),
          twon AS (SELECT *, {_argmax_sql()} AS k FROM tmeans),
          best AS (SELECT speaker, subtopic_2, {PROB_SQL}, most_important_doc, document_count FROM (
            SELECT w.*, d.document_id AS most_important_doc, row_number() OVER (
              PARTITION BY w.speaker, w.subtopic_2 ORDER BY
              CASE k WHEN 0 THEN d.p_against WHEN 1 THEN d.p_favor ELSE d.p_neutral END DESC, d.document_id) AS rn
            FROM twon w JOIN docs d USING (speaker, subtopic_2)) WHERE rn = 1)"""
    return f"""WITH {head}, {best}
      SELECT speaker, chamber, subtopic_1, subtopic_2, document_count, documents_total, document_word_count,
        CASE {_argmax_sql()} WHEN 0 THEN 'against' WHEN 1 THEN 'favor' ELSE 'neutral' END AS stance,
        round(abs(p_favor - p_against), 9) AS stance_confidence, {ROUNDED_SQL}, most_important_doc
      FROM best JOIN meta USING (speaker, subtopic_2) JOIN totals USING (speaker, subtopic_2)"""


def _pooled_topics(spark, sf, method):
    out = pool.pool_documents(_pooled_docs(spark, sf, method), method)
    return _rounded(out, "stance_confidence", *PROBS)


@query("A4", _topics_query("max"))
def pool_documents_max(spark, sf):
    return _pooled_topics(spark, sf, "max")


@query("A4", _topics_query("mean"))
def pool_documents_mean(spark, sf):
    return _pooled_topics(spark, sf, "mean")


@query("A4", _topics_query("weighted"))
def pool_documents_weighted(spark, sf):
    return _pooled_topics(spark, sf, "weighted")


@query("A5 A6", f"""WITH {fx.CHUNKS_SQL}, m AS (
   SELECT speaker, subtopic_1, avg(p_against) AS p_against, avg(p_favor) AS p_favor, avg(p_neutral) AS p_neutral
   FROM chunks GROUP BY ALL),
 w AS (SELECT *, {_argmax_sql()} AS stance FROM m)
 SELECT speaker, subtopic_1, {ROUNDED_SQL}, stance, round(abs(p_favor - p_against), 9) AS confidence,
        document_id AS top_item FROM (
   SELECT w.*, c.document_id, row_number() OVER (PARTITION BY w.speaker, w.subtopic_1 ORDER BY
     CASE stance WHEN 0 THEN c.p_against WHEN 1 THEN c.p_favor ELSE c.p_neutral END DESC, c.document_id) AS rn
   FROM w JOIN chunks c USING (speaker, subtopic_1)) WHERE rn = 1""")
def average_with_evidence(spark, sf):
    out = pool.top_evidence(
        fx.chunk_scores(spark, sf), ["speaker", "subtopic_1"], "document_id", ["document_id"]
    )
    return _rounded(out, "confidence", *PROBS)


def _scores_sql(agg: str) -> str:
    return f"""WITH {fx.RESULTS_SQL}
      SELECT speaker, subtopic_1, round({agg}, 9) AS stance_score FROM results GROUP BY ALL"""


def _topic_scores(spark, sf, method):
    return _rounded(pool.topic_scores(fx.stance_results(spark, sf), method), "stance_score")


@query("A7", _scores_sql("avg(stance_score)"))
def topic_scores_mean(spark, sf):
    return _topic_scores(spark, sf, "mean")


@query("A7", _scores_sql("sum(weight * stance_score) / nullif(sum(weight), 0)"))
def topic_scores_weighted(spark, sf):
    return _topic_scores(spark, sf, "weighted")


@query("A7", f"""WITH {fx.RESULTS_SQL}
 SELECT speaker, subtopic_1, round(stance_score, 9) AS stance_score FROM (
   SELECT *, row_number() OVER (PARTITION BY speaker, subtopic_1
     ORDER BY abs(stance_score) DESC, subtopic_2) AS rn FROM results) WHERE rn = 1""")
def topic_scores_max(spark, sf):
    return _topic_scores(spark, sf, "max")

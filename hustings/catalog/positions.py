"""Positions of speakers, scoring and labelling of texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

from ..functions import text
from ..operators import evaluate, groups, matrix, pool, resolve, scale, score, target_stance
from ..plans import fixtures as fx
from ..session import cut_lineage, written_alone
from ..sources import tables
from . import query_of_means as query, rounded
from .matrices import BRANDS, CELLS_SQL, cells
from .texts import WORDCH, tokens_sql

PARENTS_SQL = f"{CELLS_SQL}, p AS (SELECT speaker, subtopic_1 AS topic, stance_score AS y FROM parents)"


def parent_cells(spark, sf):
    return pool.topic_scores(cells(spark, sf)).withColumnRenamed("subtopic_1", "topic")


@query("W4", f"""WITH {PARENTS_SQL} SELECT a.topic AS topic_i, b.topic AS topic_j, round(covar_samp(a.y, b.y), 9) AS cov
 FROM p a JOIN p b USING (speaker) GROUP BY ALL""")
def topic_covariance(spark, sf):
    """Covariance of each two topics over the speakers who have both."""
    scores = cut_lineage(parent_cells(spark, sf).select("speaker", "topic", "stance_score"))
    one, other = (scores.select("speaker", F.col("topic").alias(f"topic_{x}"), F.col("stance_score").alias(f"_{x}")) for x in "ij")
    cov = one.join(other, "speaker").groupBy("topic_i", "topic_j").agg(F.covar_samp("_i", "_j").alias("cov"))
    return cov.withColumn("cov", rounded(F.col("cov") + F.lit(0.0), 9))


@query("W4 W8 M13", None)
def component_positions(spark, sf):
    scores = parent_cells(spark, sf)
    chambers = tables.speaker_chamber(fx.stance_results(spark, sf), "subtopic_2")
    out = scale.embedding_table(scores, chambers, "pca", 2)
    return scale.flip_axis(out, "dim2").withColumns({f"dim{i}": rounded(f"dim{i}", 6) for i in (1, 2)})


@query("W4", f"""WITH {PARENTS_SQL}, m AS (SELECT topic, avg(y) AS m FROM p GROUP BY 1)
 SELECT speaker, round(sum((y - m) ** 2), 9) AS squared_distance FROM p JOIN m USING (topic) GROUP BY 1""")
def component_distances(spark, sf):
    """Squared distance of each speaker from the mean, measured along all components."""
    scores = parent_cells(spark, sf)
    model = scale.fit_pca(scores, len(BRANDS))
    long = scale.project_cells(scores, model)
    return long.groupBy("speaker").agg(rounded(F.sum(F.col("value") ** 2), 9).alias("squared_distance"))


@query("W8 W4 W3 J7", f"""WITH {CELLS_SQL}, m AS (SELECT subtopic_2, max(subtopic_1) AS subtopic_1 FROM children GROUP BY 1),
 g AS (SELECT p.speaker, m.subtopic_2, p.stance_score AS parent FROM parents p JOIN m USING (subtopic_1)),
 o AS (SELECT speaker, subtopic_2, arg_min(stance_score, subtopic_1) AS own FROM cells GROUP BY ALL),
 f AS (SELECT speaker, subtopic_2 AS topic, coalesce(own, parent) AS y FROM g FULL JOIN o USING (speaker, subtopic_2)),
 sc AS (SELECT speaker, count(DISTINCT topic) FILTER (y <> 0) AS n FROM f GROUP BY 1),
 kept AS (SELECT f.* FROM f JOIN sc USING (speaker) WHERE n >= (SELECT quantile_cont(n, 0.75) FROM sc)),
 tc AS (SELECT t.topic, count(DISTINCT speaker) FILTER (y <> 0) AS n FROM (SELECT DISTINCT topic FROM f) t LEFT JOIN kept USING (topic) GROUP BY 1),
 good AS (SELECT kept.* FROM kept JOIN tc USING (topic) WHERE n >= (SELECT quantile_cont(n, 0.75) FROM tc)),
 s AS (SELECT DISTINCT speaker FROM good), c AS (SELECT topic, sum(y) / (SELECT count(*) FROM s) AS mean FROM good GROUP BY 1)
 SELECT speaker, round(sum((coalesce(y, 0) - mean) ** 2), 9) AS squared_distance
 FROM s CROSS JOIN c LEFT JOIN good USING (speaker, topic) GROUP BY 1""")
def subtopic_distances(spark, sf):
    """Subtopic matrix filled from the parents and filtered by coverage, reduced to all its components."""
    own = written_alone(cells(spark, sf), "own")
    filled = matrix.fill_from_parent(own, pool.topic_scores(own), resolve.topic_parents(own))
    kept = matrix.coverage_filter(filled.select("speaker", F.col("subtopic_2").alias("topic"), "stance_score"), 0.75, 0.75)
    kept = written_alone(kept, "kept")
    model = scale.fit_pca(kept, kept.select("topic").distinct().count())
    long = scale.project_cells(kept, model)
    return long.groupBy("speaker").agg(rounded(F.sum(F.col("value") ** 2), 9).alias("squared_distance"))


@query("T3 W4")
def top_loadings(spark, sf):
    model = scale.fit_pca(parent_cells(spark, sf), 3)
    top = scale.top_abs(model.loading_table(), "loading", 10, ["dim"], "topic")
    return top.withColumn("loading", rounded("loading", 6))


@query("T3", f"""WITH {PARENTS_SQL} SELECT topic, speaker, y AS stance_score, rank FROM (
   SELECT topic, speaker, round(y, 9) AS y, CAST(row_number() OVER (PARTITION BY topic ORDER BY abs(round(y, 9)) DESC, speaker) AS INTEGER) AS rank FROM p)
 WHERE rank <= 10""")
def strongest_speakers(spark, sf):
    scores = parent_cells(spark, sf).withColumn("stance_score", rounded(F.col("stance_score") + F.lit(0.0), 9))
    return scale.top_abs(scores, "stance_score", 10, ["topic"], "speaker")


@query("W4b", f"""WITH {PARENTS_SQL} SELECT speaker, round(sum(y * y), 9) AS squared_norm FROM p GROUP BY 1""")
def singular_norms(spark, sf):
    """Squared length of each speaker's row, measured along all singular vectors."""
    scores = parent_cells(spark, sf)
    model = scale.fit_svd(scores, len(BRANDS))
    long = scale.project_cells(scores, model, centered=False)
    return long.groupBy("speaker").agg(rounded(F.sum(F.col("value") ** 2), 9).alias("squared_norm"))


@query("W4b W8")
def singular_positions(spark, sf):
    scores = parent_cells(spark, sf)
    chambers = tables.speaker_chamber(fx.stance_results(spark, sf), "subtopic_2")
    out = scale.embedding_table(scores, chambers, "svd", 2)
    return out.withColumns({f"dim{i}": rounded(f"dim{i}", 6) for i in (1, 2)})


@query("W5 W7")
def irt_positions(spark, sf):
    model = scale.fit_irt(parent_cells(spark, sf), 1)
    chambers = tables.speaker_chamber(fx.stance_results(spark, sf), "subtopic_2")
    return scale.position_tables(model, chambers)["positions"]


@query("W5 W7 T3")
def irt_discrimination(spark, sf):
    """Strongest topics of a fit in which only existing cells count."""
    model = scale.fit_irt(cells(spark, sf), 1, zeros="missing")
    strength = scale.position_tables(model)["discrimination"]
    return groups.top_k(strength, [F.desc("abs_discrimination"), F.asc("topic")], 10)


@query("W6")
def irt_plane(spark, sf):
    model = scale.fit_irt(parent_cells(spark, sf), 2)
    return model.speakers.select("speaker", F.col("t0").alias("dim1"), F.col("t1").alias("dim2"))


AGAINST, FAVOR = ("de", "der", "not", "no", "but"), ("and", "with", "for", "the", "et")


def _hits_sql(words) -> str:
    return f"len(list_filter(regexp_extract_all(lower(text), '[{WORDCH}]+'), lambda w: list_contains({list(words)}, w)))"


@query("X3 P12", f"""WITH s AS (SELECT doc_id, {_hits_sql(AGAINST)} / 20.0::DOUBLE AS a, {_hits_sql(FAVOR)} / 20.0::DOUBLE AS f, 0.05::DOUBLE AS n FROM documents),
 e AS (SELECT doc_id, exp(a - greatest(a, f, n)) AS a, exp(f - greatest(a, f, n)) AS f, exp(n - greatest(a, f, n)) AS n FROM s)
 SELECT doc_id, round(a / (a + f + n), 8) AS p_against, round(f / (a + f + n), 8) AS p_favor, round(n / (a + f + n), 8) AS p_neutral FROM e""")
def scored_documents(spark, sf):
    """Every document scored by the word counting scorer, its logits damped."""
    def damped():
        model = score.lexical_scorer(AGAINST, FAVOR)()
        return lambda texts: model(texts) / 20.0

    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    out = score.score_chunks(docs, "text", damped)
    return out.select("doc_id", *[rounded(p, 8).alias(p) for p in score.PROBS])


def longest_word():
    """Labeler that takes the longest word; it fails now and then, as a remote model would."""
    word, tried = re.compile(r"[a-z]{3,}"), set()

    def label(texts):
        out = []
        for t in texts:
            if len(t) % 5 == 0 and t not in tried:
                tried.add(t)
                raise RuntimeError("busy")
            found = word.findall(t)
            out.append(min(found, key=lambda w: (-len(w), w)) if found else "")
        return out

    return label


@query("X4 S8", """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS w FROM documents),
 b AS (SELECT doc_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS rn FROM w) WHERE rn = 1)
 SELECT d.doc_id, coalesce(b.w, 'Misc.') AS label FROM documents d LEFT JOIN b USING (doc_id)""")
def generated_labels(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return score.generate_labels(docs, "text", longest_word).select("doc_id", "label")


@query("X4", """WITH l AS (SELECT doc_id, text, CASE WHEN source = 'src0' THEN 'Misc.' ELSE source END AS subtopic_1 FROM documents),
 w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all('Subtopic of ' || subtopic_1 || ': ' || text, '[a-z]{3,}')) AS w FROM l WHERE subtopic_1 <> 'Misc.'),
 b AS (SELECT doc_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS rn FROM w) WHERE rn = 1)
 SELECT l.doc_id, l.subtopic_1, b.w AS subtopic_2 FROM l LEFT JOIN b USING (doc_id)""")
def second_level_labels(spark, sf):
    docs = fx.table(spark, sf, "documents")
    links = docs.select("doc_id", F.when(F.col("source") == "src0", "Misc.").otherwise(F.col("source")).alias("subtopic_1"))
    out = score.labels_from_parents(links, docs.select("doc_id", F.col("text").alias("document")), longest_word)
    return out.select("doc_id", "subtopic_1", "subtopic_2")


@query("X5 E2")
def target_stances(spark, sf):
    """F1 of the stance on targets seen and unseen in the fit; a target is a language with its source."""
    labels = fx.table(spark, sf, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("label"))
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.concat_ws(" ", "lang", "source").alias("target"))
    seen = F.pmod(F.xxhash64("target"), F.lit(2)) == 0
    rows = labels.join(docs, "doc_id").withColumn("few", seen)
    out, _ = target_stance.out_of_fold_stances(rows, "doc_id", "text", "target", "label", "few")
    return evaluate.f1_by_flag(out, "few_shot").select("subset", rounded("f1", 6).alias("f1"))


@query("X5 T8")
def fitted_stances(spark, sf):
    """Classifier fitted on labelled documents, its predictions on the held out ones."""
    labels = fx.table(spark, sf, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("label"))
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"))
    parts = groups.stratified_split(labels, "label", "doc_id").join(docs, "doc_id")
    model, _, _ = score.fit_stance(parts.where("split = 'train'"), parts.where("split = 'val'"), features=1 << 12)
    out = score.predict_stance(model, parts.where("split = 'test'"))
    return out.select("doc_id", "label", "pred", rounded(F.array_max("probabilities"), 6).alias("sure"))


@query("F14", f"""SELECT doc_id, {tokens_sql("text")} AS "default", CAST(length(text) // 4 AS INTEGER) AS pieces FROM documents""")
def tokenizer_counts(spark, sf):
    """Tokens by a tokenizer of the user's, next to the default count."""
    @F.pandas_udf(T.IntegerType())
    def pieces(s: pd.Series) -> pd.Series:
        return s.str.len().floordiv(4)

    return fx.table(spark, sf, "documents").select(
        "doc_id", text.token_count("text").alias("default"), pieces("text").alias("pieces")
    )

"""Vectors, clusters, labels and the topic tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import cluster, density, groups, taxonomy, topics
from ..plans import fixtures as fx
from . import query
from .texts import NORM_SQL, WORDCH, words_sql

DIMS = 64


def embeddings(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("parent"))


def _dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


VEC_SQL = "vecs AS (SELECT vec_id, label AS parent, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CENTER_SQL = f"""{VEC_SQL}, dims AS (SELECT parent, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs),
 means AS (SELECT parent, i, avg(x) AS m FROM dims GROUP BY ALL),
 centers AS (SELECT parent, list(m ORDER BY i) AS c FROM means GROUP BY 1)"""


@query("M9 M10", f"""WITH {VEC_SQL}, u AS (SELECT *, list_transform(v, lambda x: x / sqrt({_dot_sql("v", "v")})) AS u FROM vecs)
 SELECT vec_id, round(u[1], 8) AS first, round(u[64], 8) AS last, round(list_sum(u), 8) AS total,
   round({_dot_sql("u", "v")} / sqrt({_dot_sql("v", "v")}), 8) AS self_cosine FROM u""")
def unit_vectors(spark, sf):
    u = vectors.l2_normalize("embedding")
    return embeddings(spark, sf).withColumn("u", u).select(
        "vec_id", F.round(F.col("u")[0], 8).alias("first"), F.round(F.col("u")[63], 8).alias("last"),
        F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 8).alias("total"),
        F.round(vectors.cosine("u", "embedding"), 8).alias("self_cosine"),
    )


@query("M11", f"""WITH {CENTER_SQL} SELECT parent, CAST(i - 1 AS INTEGER) AS pos, round(m, 9) AS mean FROM means""")
def group_centroids(spark, sf):
    centers = vectors.centroid(embeddings(spark, sf), ["parent"])
    return centers.select("parent", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", F.round("mean", 9))


@query("C5", f"""WITH {CENTER_SQL}, near AS (SELECT parent, vec_id, row_number() OVER (PARTITION BY parent ORDER BY
   {_dot_sql("v", "c")} / sqrt({_dot_sql("v", "v")} * {_dot_sql("c", "c")}) DESC, vec_id) AS rn FROM vecs JOIN centers USING (parent))
 SELECT parent, vec_id AS medoid FROM near WHERE rn = 1""")
def group_medoids(spark, sf):
    return taxonomy.medoids(embeddings(spark, sf), ["parent"], "embedding", "vec_id", "vec_id")


@query("C6", f"""WITH texts AS (SELECT e.vec_id, CASE WHEN e.label = 0 THEN -1 ELSE e.label END AS parent, CAST(e.embedding AS DOUBLE[]) AS v0, 't' || CAST(e.vec_id % 100 AS VARCHAR) AS text FROM embeddings e),
 vecs AS (SELECT parent, text, vec_id, v0 AS v FROM (SELECT *, row_number() OVER (PARTITION BY parent, text ORDER BY vec_id) AS rn FROM texts) WHERE rn = 1),
 dims AS (SELECT parent, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs),
 centers AS (SELECT parent, list(m ORDER BY i) AS c FROM (SELECT parent, i, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY 1),
 near AS (SELECT parent, text, row_number() OVER (PARTITION BY parent ORDER BY
   {_dot_sql("v", "c")} / sqrt({_dot_sql("v", "v")} * {_dot_sql("c", "c")}) DESC, vec_id) AS rn FROM vecs JOIN centers USING (parent))
 SELECT parent, CASE WHEN parent = -1 THEN 'Misc.' ELSE text END AS mean_text FROM near WHERE rn = 1""")
def mean_texts(spark, sf):
    df = embeddings(spark, sf).select(
        "vec_id", "embedding", F.when(F.col("parent") == 0, -1).otherwise(F.col("parent")).alias("parent"),
        F.concat(F.lit("t"), (F.col("vec_id") % 100).cast("string")).alias("text"),
    )
    return taxonomy.mean_text(df, ["parent"], "embedding", "text", "vec_id")


VOTED_SQL = """voted AS (SELECT doc_id, lang, source || '-' || CAST(n_chars % 10 AS VARCHAR) AS item,
   CASE WHEN doc_id % 7 = 0 THEN -1 ELSE CAST(doc_id % 3 AS INTEGER) END AS label FROM documents)"""


def voted(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", "lang", F.concat("source", F.lit("-"), (F.col("n_chars") % 10).cast("string")).alias("item"),
        F.when(F.col("doc_id") % 7 == 0, -1).otherwise((F.col("doc_id") % 3).cast("int")).alias("label"),
    )


@query("A17", f"""WITH {VOTED_SQL}, votes AS (SELECT lang, item, label, count(*) AS n, min(doc_id) AS first FROM voted GROUP BY ALL),
 best AS (SELECT lang, item, label FROM (SELECT *, row_number() OVER (PARTITION BY lang, item ORDER BY n DESC, first) AS rn FROM votes) WHERE rn = 1)
 SELECT v.doc_id, CASE WHEN item = 'src1-0' THEN -1 ELSE b.label END AS label FROM voted v JOIN best b USING (lang, item)""")
def majority_labels(spark, sf):
    out = taxonomy.enforce_majority(voted(spark, sf), "item", "label", "doc_id", ["lang"], misc="src1-0")
    return out.select("doc_id", "label")


@query("A22", f"""WITH {VOTED_SQL} SELECT lang, count(DISTINCT label) FILTER (label <> -1) AS clusters,
   count(*) FILTER (label = -1) AS noise FROM voted GROUP BY 1""")
def cluster_counts(spark, sf):
    return taxonomy.cluster_summary(voted(spark, sf), ["lang"])


@query("C13", """WITH t AS (SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN -1 ELSE CAST(doc_id % 3 AS INTEGER) END AS label FROM documents)
 SELECT doc_id, source, CASE WHEN count(DISTINCT label) OVER (PARTITION BY source) = 1 THEN 1 ELSE label END AS label FROM t""")
def promoted_clusters(spark, sf):
    label = F.when(F.col("source").isin("src1", "src2"), -1).otherwise((F.col("doc_id") % 3).cast("int"))
    df = fx.table(spark, sf, "documents").select("doc_id", "source", label.alias("label"))
    return taxonomy.promote_single(df, ["source"], "label")


@query("C4", """WITH t AS (SELECT p_partkey, p_type, CASE WHEN p_brand = 'Brand#1' THEN 'Misc.' ELSE p_brand || '/' || p_size END AS subtopic_1 FROM part),
 n AS (SELECT *, count(*) OVER (PARTITION BY p_type, subtopic_1) < 5 OR subtopic_1 = 'Misc.' AS bypass FROM t)
 SELECT p_partkey, bypass, CASE WHEN bypass AND subtopic_1 <> 'Misc.' THEN 'Misc.' END AS subtopic_2 FROM n""")
def bypassed_parents(spark, sf):
    name = F.when(F.col("p_brand") == "Brand#1", "Misc.").otherwise(F.concat_ws("/", "p_brand", "p_size"))
    df = fx.table(spark, sf, "part").select("p_partkey", "p_type", name.alias("subtopic_1"))
    out = taxonomy.route_small(df, ["p_type", "subtopic_1"], 3, "subtopic_1")
    return out.select("p_partkey", "bypass", F.when(F.col("bypass"), taxonomy.bypass_label("subtopic_1")).alias("subtopic_2"))


TERMS_SQL = f"""terms AS (SELECT source AS cluster, unnest({words_sql(NORM_SQL)}) AS term FROM documents),
 tf AS (SELECT cluster, term, count(*) AS tf FROM terms GROUP BY ALL),
 weights AS (SELECT cluster, term, tf, round(tf * ln(1 + (SELECT avg(s) FROM (SELECT sum(tf) AS s FROM tf GROUP BY cluster)) / sum(tf) OVER (PARTITION BY term)), 9) AS weight FROM tf),
 names AS (SELECT cluster, string_agg(term, '_' ORDER BY rn) AS topic_label FROM (SELECT *, row_number() OVER
   (PARTITION BY cluster ORDER BY weight DESC, term) AS rn FROM weights) WHERE rn <= 10 GROUP BY 1)"""


def tokens(spark, sf):
    return fx.table(spark, sf, "documents").select(
        F.col("source").alias("cluster"), F.explode(text.plain_words("text")).alias("term")
    )


@query("C8", f"WITH {TERMS_SQL} SELECT cluster, topic_label FROM names")
def topic_names(spark, sf):
    return taxonomy.topic_labels(tokens(spark, sf), ["cluster"])


WIDTH, MIN_POINTS, MIN_SIZE = 0.35, 2, 6
DENSITY = (0.15, 3, 5, 3)  # width of a cell, points for its core, points of a cluster, reach in cells


def _project_sql() -> str:
    rows = vectors.random_signs(2, DIMS)
    return ", ".join(f"{_dot_sql('v', str(r) + '::DOUBLE[]')} AS x{i}" for i, r in enumerate(rows))


PLACED_SQL = f"""{VEC_SQL}, projected AS (SELECT vec_id, parent, {_project_sql()} FROM vecs),
 placed AS (SELECT *, CAST(floor(x0 / {WIDTH}) AS BIGINT) AS c0, CAST(floor(x1 / {WIDTH}) AS BIGINT) AS c1 FROM projected)"""

CLUSTERS_SQL = f"""{PLACED_SQL},
 cells AS (SELECT parent, c0, c1, count(*) AS n FROM placed GROUP BY ALL HAVING count(*) >= {MIN_POINTS}),
 reach AS (SELECT parent, c0, c1, c0 AS r0, c1 AS r1 FROM cells
   UNION SELECT r.parent, r.c0, r.c1, n.c0, n.c1 FROM reach r JOIN cells n ON n.parent = r.parent
     AND abs(n.c0 - r.r0) + abs(n.c1 - r.r1) = 1),
 comp AS (SELECT parent, c0, c1, min((r0, r1)) AS root FROM reach GROUP BY ALL),
 sized AS (SELECT parent, root FROM comp JOIN cells USING (parent, c0, c1) GROUP BY ALL HAVING sum(n) >= {MIN_SIZE}),
 numbered AS (SELECT parent, root, CAST(row_number() OVER (PARTITION BY parent ORDER BY root) - 1 AS INTEGER) AS label FROM sized),
 clustered AS (SELECT p.vec_id, p.parent, p.x0, p.x1, coalesce(n.label, -1) AS label FROM placed p
   LEFT JOIN comp c USING (parent, c0, c1) LEFT JOIN numbered n ON n.parent = c.parent AND n.root = c.root)"""


@query("C2", f"WITH {PLACED_SQL} SELECT vec_id, parent, round(x0, 8) AS x0, round(x1, 8) AS x1 FROM projected")
def projected_vectors(spark, sf):
    out = cluster.project(embeddings(spark, sf), "embedding", 2, DIMS)
    return out.select("vec_id", "parent", F.round("x0", 8).alias("x0"), F.round("x1", 8).alias("x1"))


@query("C2")
def principal_projection(spark, sf):
    out = cluster.project(embeddings(spark, sf), "embedding", 5, DIMS, method="pca")
    return out.select("vec_id", "parent", *[F.round(f"x{i}", 6).alias(f"x{i}") for i in range(5)])


def clusters(spark, sf):
    points = cluster.project(embeddings(spark, sf), "embedding", 2, DIMS)
    return cluster.density_cluster(points, ["parent"], ["x0", "x1"], WIDTH, MIN_POINTS, MIN_SIZE)


@query("C3", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT vec_id, parent, label FROM clustered")
def density_clusters(spark, sf):
    return clusters(spark, sf).select("vec_id", "parent", "label")


@query("C3")
def density_hierarchy(spark, sf):
    """The most stable clusters of each parent's density hierarchy."""
    points = cluster.project(embeddings(spark, sf), "embedding", 2, DIMS)
    return density.hierarchical_clusters(points, ["parent"], ["x0", "x1"], *DENSITY).select("vec_id", "parent", "label")


@query("C7")
def density_validities(spark, sf):
    """Validity of these clusters, with noise and without."""
    points = cluster.project(embeddings(spark, sf), "embedding", 2, DIMS)
    out = density.density_validity(points, ["parent"], ["x0", "x1"], *DENSITY)
    return out.withColumns({c: F.round(c, 7) for c in ("validity", "validity_clustered")})


@query("C9")
def topic_linkage(spark, sf):
    """All merges of the topics' hierarchy."""
    centers = vectors.centroid(embeddings(spark, sf), ["parent"], out="center").withColumnRenamed("parent", "topic")
    return cluster.average_linkage(centers, "topic", "center").withColumn("distance", F.round("distance", 8))


QUALITY_SQL = """k AS (SELECT * FROM clustered WHERE label <> -1),
 d AS (SELECT a.vec_id, a.parent, a.label, b.label AS other, sum((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2) AS s, count(*) AS n
   FROM k a JOIN k b USING (parent) GROUP BY ALL),
 ab AS (SELECT vec_id, parent, max(CASE WHEN label = other THEN s / nullif(n - 1, 0) END) AS a,
   min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY ALL),
 q AS (SELECT parent, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS quality,
   count(*) AS clustered FROM ab GROUP BY 1)"""


@query("C7", f"""WITH RECURSIVE {CLUSTERS_SQL}, {QUALITY_SQL}
 SELECT parent, points, round(quality, 7) AS quality, clustered FROM (SELECT parent, count(*) AS points FROM clustered GROUP BY 1) LEFT JOIN q USING (parent)""")
def cluster_qualities(spark, sf):
    out = cluster.cluster_quality(clusters(spark, sf), ["parent"], ["x0", "x1"], "vec_id")
    return out.withColumn("quality", F.round("quality", 7))


@query("C7", f"""WITH RECURSIVE {CLUSTERS_SQL}, {QUALITY_SQL}
 SELECT round(sum(quality * points) / sum(points), 7) AS by_points, round(sum(quality * clustered) / sum(clustered), 7) AS without_noise
 FROM (SELECT parent, count(*) AS points FROM clustered GROUP BY 1) JOIN q USING (parent)""")
def weighted_cluster_quality(spark, sf):
    """Mean quality over all parents, by their points and by their points without noise."""
    quality = cluster.cluster_quality(clusters(spark, sf), ["parent"], ["x0", "x1"], "vec_id")
    whole = cluster.weighted_quality(quality).select(F.round("quality", 7).alias("by_points"))
    return whole.withColumn("without_noise", F.round(cluster.weighted_quality(quality, True).scalar(), 7))


@query("C11 A16 A22", f"""WITH RECURSIVE {CLUSTERS_SQL}, {TERMS_SQL},
 members AS (SELECT c.parent, c.label, c.vec_id AS doc_id, CAST(e.embedding AS DOUBLE[]) AS v FROM clustered c JOIN embeddings e USING (vec_id)),
 dims AS (SELECT parent, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM members),
 centers AS (SELECT parent, label, list(m ORDER BY i) AS c FROM (SELECT parent, label, i, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY ALL),
 med AS (SELECT parent, label, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY parent, label ORDER BY
   {_dot_sql("v", "c")} / sqrt({_dot_sql("v", "v")} * {_dot_sql("c", "c")}) DESC, doc_id) AS rn FROM members JOIN centers USING (parent, label)) WHERE rn = 1),
 nodes AS (SELECT parent, label, count(*) AS cluster_length, count(DISTINCT doc_id) AS documents FROM members GROUP BY ALL)
 SELECT parent, label, cluster_length, documents, CASE WHEN label = -1 THEN 'Misc. (Noise)' ELSE CAST(doc_id AS VARCHAR) END AS medoid,
   CASE WHEN label = -1 THEN 'Misc.' ELSE 'topic ' || label END AS topic_label FROM nodes JOIN med USING (parent, label)""")
def taxonomy_nodes(spark, sf):
    members = clusters(spark, sf).withColumn("doc_id", F.col("vec_id"))
    by = ["parent", "label"]
    centers = taxonomy.medoids(members, by, "embedding", "vec_id", "vec_id").withColumn("medoid", F.col("medoid").cast("string"))
    labels = members.select(*by).distinct().withColumn("topic_label", F.concat(F.lit("topic "), F.col("label").cast("string")))
    return taxonomy.build_taxonomy(members, labels, centers, ["parent"])


NODES_SQL = """nodes AS (SELECT p_type AS policy_area, CASE WHEN p_brand = 'Brand#1' THEN 'Misc.' ELSE p_brand END AS subtopic_1,
   CAST(p_size AS VARCHAR) AS subtopic_2, count(*) AS cluster_length FROM part GROUP BY ALL)"""


def nodes(spark, sf):
    s1 = F.when(F.col("p_brand") == "Brand#1", "Misc.").otherwise(F.col("p_brand"))
    return fx.table(spark, sf, "part").groupBy(
        F.col("p_type").alias("policy_area"), s1.alias("subtopic_1"), F.col("p_size").cast("string").alias("subtopic_2")
    ).agg(F.count("*").alias("cluster_length"))


@query("A15 T9 M12", f"""WITH {NODES_SQL}, tree AS (
   SELECT 0 AS level, NULL AS policy_area, NULL AS subtopic_1, NULL AS subtopic_2, CAST(sum(cluster_length) AS BIGINT) AS n FROM nodes
   UNION ALL SELECT 1, policy_area, NULL, NULL, CAST(sum(cluster_length) AS BIGINT) FROM nodes GROUP BY policy_area
   UNION ALL SELECT 2, policy_area, subtopic_1, NULL, CAST(sum(cluster_length) AS BIGINT) FROM nodes GROUP BY policy_area, subtopic_1
   UNION ALL SELECT 3, policy_area, subtopic_1, subtopic_2, CAST(sum(cluster_length) AS BIGINT) FROM nodes
     WHERE subtopic_1 <> 'Misc.' GROUP BY policy_area, subtopic_1, subtopic_2),
 keyed AS (SELECT *, CASE WHEN level > 1 THEN policy_area END AS p, CASE WHEN level > 2 THEN subtopic_1 END AS s FROM tree)
 SELECT k.level, k.policy_area, k.subtopic_1, k.subtopic_2, k.n, round(k.n * 100.0 / coalesce(u.n, k.n), 6) AS pct_of_parent,
   round(k.n * 100.0 / (SELECT sum(cluster_length) FROM nodes), 6) AS pct_of_total,
   CAST(row_number() OVER (PARTITION BY k.level, k.p, k.s ORDER BY k.n DESC, k.policy_area, k.subtopic_1, k.subtopic_2) AS INTEGER) AS place
 FROM keyed k LEFT JOIN tree u ON u.level = k.level - 1 AND u.policy_area IS NOT DISTINCT FROM k.p AND u.subtopic_1 IS NOT DISTINCT FROM k.s""")
def topic_tree(spark, sf):
    out = taxonomy.taxonomy_tree(nodes(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("pct_of_parent", "pct_of_total")})


@query("M12", f"""WITH {NODES_SQL} SELECT *, round(cluster_length * 100.0 / sum(cluster_length) OVER (PARTITION BY policy_area), 6) AS pct_of_parent,
   round(cluster_length * 100.0 / sum(cluster_length) OVER (), 6) AS pct_of_total FROM nodes""")
def node_shares(spark, sf):
    out = groups.share(nodes(spark, sf), "cluster_length", ["policy_area"])
    return out.withColumns({c: F.round(c, 6) for c in ("pct_of_parent", "pct_of_total")})


@query("A16", "SELECT DISTINCT p_type AS policy_area, p_brand AS subtopic_1, p_partkey AS doc_id FROM part")
def node_links(spark, sf):
    docs = fx.table(spark, sf, "part").select(
        F.col("p_type").alias("policy_area"), F.col("p_brand").alias("subtopic_1"), F.col("p_partkey").alias("doc_id")
    )
    return taxonomy.node_documents(docs, ["policy_area", "subtopic_1"])


@query("C12", """SELECT 0 AS level, count(DISTINCT p_type) AS topics, count(DISTINCT p_partkey) AS documents FROM part
 UNION ALL SELECT 1, count(DISTINCT p_type || p_brand), count(DISTINCT p_partkey) FROM part
 UNION ALL SELECT 2, count(DISTINCT p_type || p_brand || '|' || p_size), count(DISTINCT p_partkey) FROM part""")
def path_level_counts(spark, sf):
    paths = fx.table(spark, sf, "part").select("p_type", "p_brand", "p_size", F.col("p_partkey").alias("doc_id"))
    return taxonomy.level_counts(paths, ["p_type", "p_brand", "p_size"])


@query("C1", f"""SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[{WORDCH}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
   256 AS size FROM documents""")
def text_embeddings(spark, sf):
    """Vectors have unit length; those of texts without a word, zero."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    out = cluster.embed_texts(docs, "text")
    return out.select("doc_id", F.round(vectors.norm("embedding"), 6).alias("norm"), F.size("embedding").alias("size"))


@query("C9")
def topic_parents_by_vector(spark, sf):
    centers = vectors.centroid(embeddings(spark, sf), ["parent"], out="center").withColumnRenamed("parent", "topic")
    return cluster.topic_hierarchy(centers, "topic", "center", 3)


@query("C10")
def two_level_topics(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", text.plain_words("text").alias("words"))
    out = topics.lda_taxonomy(docs, "words", 4, 3, tol=1e-3, keep=["doc_id"])
    return out.select("doc_id", "topic_1", "topic_1_words", "topic_2", "topic_2_words")

"""Speaker by topic matrices, kept long; wide only where a file wants it.

A cell that is missing counts as score 0 in the filled matrix. It is not written down:
coverage, covariance and fits work from the cells that exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, written, written_alone
from .ordering import count_quantile
from .resolve import counts_with_zero

MAX_COLUMNS = 10_000


def topic_list(cells: DataFrame, col: str = "topic", limit: int = MAX_COLUMNS) -> list[str]:
    """Sorted topics, for a wide sink; more than a table can have columns is an error."""
    found = [r[0] for r in cells.select(col).distinct().orderBy(col).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} topics do not fit a wide table")
    return found


def to_matrix(
    cells: DataFrame, topics: Sequence[str], key: str = "speaker", value: str = "stance_score",
    order: str | None = None,
) -> DataFrame:
    """Wide matrix with one column per topic; the first value of a cell counts."""
    return cells.groupBy(key).pivot("topic", list(topics)).agg(first_value(value, order))


def first_value(value: str, order: str | None = None) -> Column:
    """The value that counts of a cell given several times: the first in order, else the largest."""
    return F.min_by(value, order) if order else F.max(value)


def one_per_cell(cells: DataFrame, order: str | None = None) -> DataFrame:
    """``speaker, topic, stance_score``, each cell once, by the same rule as in the wide matrix."""
    return cells.groupBy("speaker", "topic").agg(first_value("stance_score", order).alias("stance_score"))


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def to_long(wide: DataFrame, keys: Sequence[str], topics: Sequence[str]) -> DataFrame:
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(quoted(t)).alias("stance_score")) for t in topics]))
    long = wide.select(*[F.col(quoted(k)) for k in keys], entries.alias("_e"))
    return long.select(*[F.col(quoted(k)) for k in keys], "_e.topic", "_e.stance_score").where(F.col("stance_score").isNotNull())


def fill_from_parent(cells: DataFrame, parents: DataFrame, children: DataFrame, order: str = "subtopic_1") -> DataFrame:
    """Each subtopic_2 a speaker took up, or whose topic they took up: own score, else the parent's.

    ``children`` maps ``subtopic_2`` to ``subtopic_1``. An own score counts whatever topic it was
    given under; of several the first in ``order``. Cells with neither own nor parent score are
    the zeros of the filled matrix and stay unwritten.

    Scores and parents' scores are dealt by speaker, and all cells of a speaker are made where
    these lie: the filled matrix, many times as long, is not shuffled. ``children`` is small
    beside it, used twice and written to the shared folder once for that.
    """
    children = written(children.select("subtopic_2", "subtopic_1"), "children")
    first = F.min_by(F.struct("stance_score", "subtopic_1"), order)
    own = cells.repartition("speaker").groupBy("speaker", "subtopic_2").agg(first.alias("_f")).select(
        "speaker", "subtopic_2", F.lit(None).cast(parents.schema["subtopic_1"].dataType).alias("subtopic_1"),
        F.lit(None).cast(parents.schema["stance_score"].dataType).alias("_parent"),
        F.col("_f.stance_score").alias("_own"), F.col("_f.subtopic_1").alias("_under"), F.lit(False).alias("_grid"),
    )
    grid = parents.repartition("speaker").join(children, "subtopic_1").select(
        "speaker", "subtopic_2", "subtopic_1", F.col("stance_score").alias("_parent"),
        F.lit(None).cast(own.schema["_own"].dataType).alias("_own"), F.lit(None).cast(own.schema["_under"].dataType).alias("_under"),
        F.lit(True).alias("_grid"),
    )
    # As a full join meets them: cells of no speaker or no subtopic stay apart.
    apart = F.when(F.col("speaker").isNull() | F.col("subtopic_2").isNull(), F.col("_grid"))
    cell = Window.partitionBy("speaker", "subtopic_2", "_apart")
    met = own.unionByName(grid).withColumn("_apart", apart).withColumns(
        {"_own": F.max("_own").over(cell), "_under": F.max("_under").over(cell), "_any": F.max("_grid").over(cell)}
    ).where(F.col("_grid") | ~F.col("_any"))
    mapped = children.select("subtopic_2", F.col("subtopic_1").alias("_mapped"))
    return met.join(mapped, "subtopic_2", "left").select(
        "speaker",
        F.coalesce("subtopic_1", "_mapped", "_under").alias("subtopic_1"),
        "subtopic_2",
        F.coalesce("_own", "_parent").alias("stance_score"),
        F.col("_own").isNotNull().alias("observed"),
    )


def filled_matrix(filled: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Wide filled matrix, zeros written out."""
    wide = to_matrix(filled.select("speaker", F.col("subtopic_2").alias("topic"), "stance_score"), topics)
    return wide.select("speaker", *[F.coalesce(F.col(quoted(t)), F.lit(0.0)).alias(t) for t in topics])


def coverage_counts(cells: DataFrame, by: str, of: str, out: str = "n", once: str | None = None) -> DataFrame:
    """Distinct non-zero partners per key, keys without any counted as 0.

    ``once`` names a column that is true in one cell of each pair with a non-zero one, if there is
    such a column; tasks then add up their cells, and no pairs are shuffled.
    """
    if once:
        partners = F.count_if(F.col(once) & F.col(of).isNotNull())
    else:
        partners = F.count_distinct(F.when(F.col("stance_score") != 0, F.col(of)))
    return cells.groupBy(by).agg(partners.alias(out))


def _marked(cells: DataFrame, topic: str) -> DataFrame:
    """``_once``, true in one cell of each speaker and topic that have a non-zero one, and ``_n``, how many the speaker has."""
    cells = cells.withColumn("_some", F.coalesce(F.col("stance_score") != 0, F.lit(False)))
    speaker = Window.partitionBy("speaker")
    topics = speaker.orderBy(topic)
    same = topics.rangeBetween(Window.currentRow, Window.currentRow)
    cells = cells.withColumns({"_before": F.lag(topic).over(topics), "_some": F.max("_some").over(same)})
    cells = cells.withColumn("_once", F.col("_some") & ~F.col("_before").eqNullSafe(F.col(topic))).drop("_some", "_before")
    return cells.withColumn("_n", F.count_if(F.col("_once") & F.col(topic).isNotNull()).over(speaker))


def _at_least(counts: DataFrame, q: float) -> DataFrame:
    return counts.where(F.col("n") >= count_quantile(counts, "n", q).scalar())


def coverage_filter(
    cells: DataFrame, speaker_p: float = 0.75, topic_p: float = 0.75, min_coverage: float = 0.0,
    topic: str = "topic",
) -> DataFrame:
    """Keep well covered speakers, then topics well covered by the speakers kept.

    Topics have to reach both the percentile and the coverage share. A topic that none of the
    kept speakers has counts as covered by 0 in the percentile. The cells are gone through
    several times and written to the shared folder once for that, each with what its speaker
    covers, so that later steps read them where they lie.
    """
    cells = written_alone(_marked(cells, topic), "cells")
    topics = cells.select(topic).distinct()
    if speaker_p > 0:
        least = count_quantile(coverage_counts(cells, "speaker", topic, once="_once"), "n", speaker_p).first()[0]
        cells = cells.where(F.col("speaker").isNotNull() & (F.col("_n") >= F.lit(least)))
    counts = counts_with_zero(topics, coverage_counts(cells, topic, "speaker", once="_once"), [topic], "n")
    good = counts = written(counts, "topics")
    if topic_p > 0:
        good = _at_least(counts, topic_p)
    if min_coverage > 0:
        everyone = cells.agg(F.count_distinct("speaker")).scalar()
        good = good.where(F.try_divide(F.col("n"), everyone) >= min_coverage)
    return cells.drop("_once", "_n").join(good.select(topic), topic, "left_semi")


def coverage_report(cells: DataFrame, by: str, of: str) -> DataFrame:
    """Share of partners covered per key, over all partners there are."""
    cells = cut_lineage(cells.select(by, of, "stance_score"))
    partners = cells.agg(F.count_distinct(of)).scalar()
    return coverage_counts(cells, by, of).withColumn("coverage", F.try_divide(F.col("n"), partners))


def coverage_summary(cells: DataFrame, by: str, of: str) -> DataFrame:
    """Mean, median and sample deviation of coverage (NULL of one key), and the share of cells missing."""
    report = coverage_report(cells, by, of)
    merged = report.groupBy("coverage").agg(F.count("*").alias("_f"))
    f, c = F.col("_f"), F.col("coverage")
    median = F.percentile(c, F.lit(0.5), f)
    mean = F.try_divide(F.sum(c * f), F.sum(f))
    spread = F.sqrt(F.try_divide(F.sum(c * c * f) - F.sum(f) * mean * mean, F.sum(f) - 1))
    return merged.agg(
        F.sum(f).alias("keys"),
        mean.alias("mean_coverage"),
        median.alias("median_coverage"),
        spread.alias("std_coverage"),
        ((F.lit(1.0) - mean) * 100).alias("pct_missing"),
    )

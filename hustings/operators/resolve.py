"""Matching names to rosters and speeches to bills.

Every lookup side is brought to one row per key before it is joined, so a popular key never
multiplies rows; the join strategy is left to the size Spark measures at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text
from .ordering import first_by


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """Best bill per title: latest summary, else latest update, else first seen.

    Wants ``title, bill_type, bill_number, summary_date, update_date, seen``.
    """
    has = F.col("summary_date").isNotNull()
    order = [
        F.when(has, 0).otherwise(1),
        -F.unix_date("summary_date"),
        F.when(has, 0).otherwise(-F.coalesce(F.unix_date("update_date"), F.lit(-(1 << 30)))),
        F.col("seen"),
    ]
    return first_by(aliases.where(F.col("title").isNotNull()), ["title"], order)


def latest_summary(summaries: DataFrame) -> DataFrame:
    """Latest summary per bill by action date, the first one on ties, no date counted oldest."""
    day = F.coalesce(F.col("action_date"), F.lit(fixed.EPOCH).cast("date"))
    return first_by(summaries, ["bill_type", "bill_number"], [-F.unix_date(day), F.col("seen")])


def all_titles(bills: DataFrame) -> DataFrame:
    """One row per bill and distinct title, main title and alternative titles together."""
    titles = F.array_union(
        F.transform(F.col("alternatives"), text.standardize_title),
        F.array(text.standardize_title("title")),
    )
    exploded = bills.withColumn("title", F.explode(titles)).drop("alternatives")
    return exploded.where(F.col("title").isNotNull())


def match_bills(speeches: DataFrame, bills: DataFrame, title: str = "doc_title") -> DataFrame:
    """Attach the bill of the same normalised title; speeches without one keep NULLs."""
    keyed = speeches.withColumn("standardized_title", text.standardize_title(title))
    return keyed.join(bills.withColumnRenamed("title", "standardized_title"), "standardized_title", "left")


def enrich(bills: DataFrame, details: DataFrame) -> DataFrame:
    return bills.join(details, ["bill_type", "bill_number"], "left")


def merge_taxonomy(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Topics of each document by (document, policy area); the last node wins a document.

    ``nodes`` is the link table ``doc_id, policy_area, subtopic_1, subtopic_2, node_pos``.
    A document claimed last by a node of another policy area gets none.
    """
    last = first_by(nodes, ["doc_id"], [-F.col("node_pos")]).drop("node_pos")
    return docs.join(last, ["doc_id", "policy_area"], "left")


def add_chamber(df: DataFrame, chambers: DataFrame) -> DataFrame:
    return df.join(chambers, "speaker", "left")


def counts_with_zero(keys: DataFrame, counts: DataFrame, on: Sequence[str], col: str) -> DataFrame:
    return keys.join(counts, list(on), "left").withColumn(col, F.coalesce(F.col(col), F.lit(0)))


def keep(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def topic_parents(df: DataFrame, order: str | Column = "subtopic_1") -> DataFrame:
    """Parent of each subtopic_2; of several pairs the one that comes up last for the first time wins."""
    if isinstance(order, str) and order == "subtopic_1":
        # The same in all rows of a pair: told apart by hash, not sorted for the least of strings.
        pairs = df.select("subtopic_2", "subtopic_1").distinct().withColumn("_at", F.col("subtopic_1"))
    else:
        at = F.col(order) if isinstance(order, str) else order
        pairs = df.groupBy("subtopic_2", "subtopic_1").agg(F.min(at).alias("_at"))
    return pairs.groupBy("subtopic_2").agg(F.max_by("subtopic_1", F.struct("_at", "subtopic_1")).alias("subtopic_1"))


def _override(speaker: Column, chamber: Column, rows: Sequence[tuple]) -> Column:
    out = F.lit(None).cast("struct<chamber:string,party:string>")
    for name, if_chamber, o_chamber, o_party in reversed(list(rows)):
        hit = speaker == F.lit(name)
        if if_chamber is not None:
            hit = hit & (chamber == F.lit(if_chamber))
        forced = F.struct(F.lit(o_chamber).alias("chamber"), F.lit(o_party).alias("party"))
        out = F.when(hit, forced).otherwise(out)
    return out


def match_roster(
    speakers: DataFrame,
    roster: DataFrame,
    overrides: Sequence[tuple] = fixed.ROSTER_OVERRIDES,
    exact: bool = False,
) -> DataFrame:
    """Party of each ``speaker, chamber`` by last name and chamber.

    One roster entry decides by itself, several need the state, anything else is ``UNK``.
    Overrides go first. The roster wants ``speaker, chamber, party, state, roster_pos``.
    """
    name = F.col("speaker") if exact else F.upper("speaker")
    entries = roster.select(
        name.alias("_key"), "chamber", "party", "state", "roster_pos"
    )
    by_name = entries.groupBy("_key", "chamber").agg(
        F.count("*").alias("_hits"), F.min_by("party", "roster_pos").alias("_only")
    )
    by_state = entries.groupBy("_key", "chamber", F.col("state").alias("_state")).agg(
        F.min_by("party", "roster_pos").alias("_of_state")
    )
    parsed = text.parse_speaker("speaker")
    key = parsed["lastname"] if exact else F.upper(parsed["lastname"])
    code = F.coalesce(F.upper(F.substring("chamber", 1, 1)), F.lit("H"))
    out = (
        speakers.withColumns({"_given": F.col("chamber"), "chamber": code})
        .withColumns({"lastname": parsed["lastname"], "state": parsed["state"], "_key": key})
        .withColumn("_state", F.col("state"))
        .join(by_name, ["_key", "chamber"], "left")
        .join(by_state, ["_key", "chamber", "_state"], "left")
    )
    forced = _override(F.col("speaker"), F.col("chamber"), overrides)
    found = F.when(F.col("_hits") == 1, F.col("_only")).when(F.col("_hits") > 1, F.col("_of_state"))
    out = out.withColumns(
        {
            "party": F.coalesce(forced["party"], found, F.lit("UNK")),
            "chamber": F.coalesce(forced["chamber"], F.col("chamber")),
        }
    )
    return out.drop("_given", "_key", "_state", "_hits", "_only", "_of_state")


def filter_party(cells: DataFrame, matched: DataFrame, party: str) -> DataFrame:
    """Rows of speakers of one party; all rows when no speaker has it."""
    members = matched.where(F.col("party") == party).select("speaker").distinct()
    some = members.limit(1).agg((F.count("*") > 0).alias("some")).scalar()
    flags = members.withColumn("_in", F.lit(True))
    return (
        cells.join(flags, "speaker", "left")
        .where(F.col("_in") | ~some)
        .drop("_in")
    )


def match_scores(
    points: DataFrame,
    roster: DataFrame,
    scores: DataFrame,
    overrides: Sequence[tuple] = fixed.SCORE_OVERRIDES,
    exact: bool = False,
) -> DataFrame:
    """External record of each speaker; ``bioname`` is NULL where none was found.

    ``scores`` has ``bioname, lastname, chamber, party, score_pos`` next to the score columns.
    """
    forced = F.lit(None).cast("struct<chamber:string,party:string,bioname:string>")
    for name, chamber, party, bioname in reversed(list(overrides)):
        forced = F.when(
            F.col("speaker") == name,
            F.struct(
                F.lit(chamber).alias("chamber"),
                F.lit(party).alias("party"),
                F.lit(bioname).alias("bioname"),
            ),
        ).otherwise(forced)
    matched = match_roster(points, roster, overrides=(), exact=exact).withColumn("_forced", forced)
    matched = matched.withColumns(
        {
            "party": F.coalesce("_forced.party", "party"),
            "chamber": F.coalesce("_forced.chamber", "chamber"),
            "_bio": F.col("_forced.bioname"),
            "_last": F.col("lastname") if exact else F.upper("lastname"),
        }
    )
    record = F.struct("bioname", "score1", "score2", "external_id")
    last = F.col("lastname") if exact else F.upper("lastname")
    by_name = scores.groupBy(F.col("bioname").alias("_bio")).agg(
        F.min_by(record, "score_pos").alias("_named")
    )
    by_key = scores.groupBy(last.alias("_last"), "chamber", "party").agg(
        F.min_by(record, "score_pos").alias("_keyed")
    )
    hit = F.when(F.col("_forced").isNotNull(), F.col("_named")).otherwise(F.col("_keyed"))
    return (
        matched.join(by_name, "_bio", "left")
        .join(by_key, ["_last", "chamber", "party"], "left")
        .withColumn("_hit", hit)
        .select(
            *[c for c in matched.columns if not c.startswith("_")],
            "_hit.bioname",
            "_hit.score1",
            "_hit.score2",
            "_hit.external_id",
        )
    )


def missing_names(left: DataFrame, right: DataFrame, col: str = "speaker") -> DataFrame:
    names = left.select(col).where(F.col(col).isNotNull()).distinct()
    return names.join(right.select(col), col, "left_anti")


def add_knowledge(df: DataFrame, wiki: DataFrame, topic: str = "topic") -> DataFrame:
    """Background text of each topic by lookup; topics without one keep NULL."""
    return df.join(wiki.select(F.col("topic").alias(topic), "knowledge"), topic, "left")

"""Quality rules kept in a ledger: every rule evaluated once, failures as bits, policies on top.

Built-in functions only, one pass over the texts without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import query, table

WHITE = r"[\x20\x09-\x0D]"
INK = r"[^\x20\x09-\x0D]"
TRIMMED = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


class Rule(NamedTuple):
    name: str
    fails: str  # SQL over the measurements, in whole numbers


# The place in this list is the rule's bit in every ledger; add at the end, never reorder.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
# Versioned policies: the rules that reject a document.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: tuple(r.name for r in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask(version: int) -> int:
    return sum(bit(name) for name in POLICIES[version])


def _windows(hashes: Column) -> Column:
    """Hash of every run of five words. Only texts of one row are compared by these 64 bits."""
    n = F.size(hashes)
    return F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the measurements of each row's text; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(TRIMMED))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{WHITE}+"))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(INK))
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    names = [f"_k{i}" for i in range(len(keep))]
    first = df.select(*kept, words.alias("_w"), lines.alias("_l"), F.regexp_count(t, F.lit(SYMBOLS)).alias("_s"))
    second = first.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.col("_s").cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    base = [*names, *MEASURES[:-1]]
    windows = second.select(*base, _windows(F.col("_h")).alias("_g"))
    # Most texts repeat no window, and the sort below is left out for them.
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    placed = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    ordered = windows.select(*base, F.when(again, placed).alias("_p"))
    p = F.col("_p")
    same = F.filter(
        p, lambda x, i: (x["g"] == F.get(p, i + 1)["g"]) | ((i > 0) & (x["g"] == F.get(p, i - 1)["g"]))
    )
    starts = ordered.select(*base, F.sort_array(F.transform(same, lambda x: x["i"])).alias("_i"))
    at = F.col("_i")
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    out = starts.select(*base, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.select(*[F.col(a).alias(c) for a, c in zip(names, keep)], *MEASURES)


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failed_bits long``: bit k is set where rule k fails.

    One row for each row that comes in, in place: nulls in ``keep`` stay, a null or empty text
    measures 0 throughout and fails ``few_words``, repeated rows are measured each for itself,
    an empty table gives an empty ledger, and other columns of ``df`` are not looked at.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    total = bits[0].cast("long")
    for b in bits[1:]:
        total = total.bitwiseOR(b.cast("long"))
    return measured(df, text, keep).withColumn("failed_bits", total)


def accepts(version: int) -> Column:
    """Verdict of a policy over a ledger."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(version)).cast("long")) == 0


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: rows that fail it, fail nothing else, and are kept without it.

    Rows are first counted by bit pattern, of which there are at most 2 to the number of rules.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("_n"))
    whole = mask(version)
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bit(n)).cast("long").alias("bit")) for n in POLICIES[version]])
    each = patterns.select("failed_bits", "_n", F.inline(rules))
    seen = F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long"))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("_n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(seen == F.col("bit"), F.col("_n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(seen.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("_n")).otherwise(0)).alias("n_kept_without"),
    )


def accepted(docs: DataFrame, version: int, text: str = "text") -> DataFrame:
    """Rows whose text passes a policy, with all their columns.

    The ledger is worked out beside the row and dropped again, so nothing is joined. Rows are
    let through by a generator and not by a filter, which Spark would push down with all
    measurements written out into one expression.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_row"), F.col(f"`{text}`").alias("_text"))
    return ledger(rows, "_text", ("_row",)).select(F.inline(F.when(accepts(version), F.array("_row"))))


MEASURED_SQL = r"""
texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
split_up AS (
  SELECT rid, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM texts),
windows AS (
  SELECT rid, unnest(list_transform(range(1, len(ws) - 3), lambda i: {'i': i, 'g': array_to_string(ws[i:i + 4], ' ')})) AS x
  FROM split_up),
repeated AS (
  SELECT rid, i FROM (SELECT rid, x.i AS i, count(*) OVER (PARTITION BY rid, x.g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeated, range(5) AS r(k) GROUP BY rid),
measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split_up LEFT JOIN covered USING (rid)),
ledger AS (
  SELECT *, """ + " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES)) + """ AS failed_bits
  FROM measured)"""


@query(
    f"""WITH {MEASURED_SQL}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           (failed_bits & {mask(2) | mask(1)}) = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits, 2 AS policy
    FROM ledger"""
)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the newest policy."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(1)).cast("long")) != 0
    return ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (accepts(2) & ~base).alias("kept"), "failed_bits", F.lit(2).alias("policy"),
    )

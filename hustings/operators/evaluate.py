"""Agreement of predictions, taxonomies and positions with what they are held against."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text
from ..session import cut_lineage, written
from .ordering import average_rank, exact_quantiles, top_per_group


# Classification -------------------------------------------------------------------------

def classification_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per class seen in ``truth`` or ``pred``; unlabelled rows are left out.

    A measure without a denominator is 0.
    """
    by = list(by)
    known = df.where(F.col("truth").isNotNull() & (F.col("truth") != -1))
    pairs = known.groupBy(*by, "truth", "pred").agg(F.count("*").alias("_n"))
    hit = F.when(F.col("truth") == F.col("pred"), F.col("_n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("_n").alias("t"), F.lit(0).cast("long").alias("p"), hit.cast("long").alias("h")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("_n").alias("p"), F.lit(0).cast("long").alias("h")),
    )
    counts = (
        pairs.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.class")
        .agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.h").alias("hits"))
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    h, t, p = F.col("hits"), F.col("support"), F.col("predicted")
    return counts.select(
        *by, "class", "support", ratio(h, p).alias("precision"), ratio(h, t).alias("recall"),
        ratio(2 * h, p + t).alias("f1"),
    )


def macro(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = ("precision", "recall", "f1")
    grouped = report.groupBy(*by) if by else report.groupBy()
    return grouped.agg(*[F.avg(n).alias(n) for n in names])


def f1_by_flag(df: DataFrame, flag: str) -> DataFrame:
    """Macro F1 over all rows and apart for rows with and without the flag."""
    tags = F.array(F.lit("all"), F.when(F.col(flag), "few_shot").otherwise("zero_shot"))
    tagged = df.withColumn("subset", F.explode(tags))
    return macro(classification_report(tagged, ["subset"]), ["subset"]).select("subset", "f1")


def multi_target_f1(df: DataFrame, k: int = 3) -> DataFrame:
    """Macro F1 per target place over genuine cells, then its mean, also by the few-shot flag.

    Wants array columns ``truth, pred, few, valid``. A place without few (or zero) shot
    cells counts as 0 there; a place without any genuine cell is left out overall.
    """
    cells = df.select(F.posexplode(F.arrays_zip("truth", "pred", "few", "valid")).alias("place", "c"))
    cells = cells.where(F.col("c.valid") == 1).select("place", "c.truth", "c.pred", (F.col("c.few") == 1).alias("few"))
    tags = F.array(F.lit("all"), F.when(F.col("few"), "few_shot").otherwise("zero_shot"))
    tagged = cells.withColumn("subset", F.explode(tags))
    per = macro(classification_report(tagged, ["subset", "place"]), ["subset", "place"])
    places = F.when(F.col("subset") == "all", F.count("*")).otherwise(F.lit(k))
    return per.groupBy("subset").agg((F.sum("f1") / places).alias("f1"))


# Taxonomy against gold labels -----------------------------------------------------------

def gold_labels(df: DataFrame, field: str) -> DataFrame:
    """(document, gold label) rows; a document with no label left has one row with NULL."""
    named = df.where(F.coalesce(F.col("policy_area"), F.lit("")) != "")
    names = F.array_distinct(F.filter(text.names_from_json(field), lambda n: n != ""))
    return named.select("doc_id", "policy_area", F.explode_outer(names).alias("name")).select(
        "doc_id", text.label_key("policy_area", "name").alias("gold")
    )


def taxonomy_coverage(docs: DataFrame, gold: DataFrame, gen: DataFrame) -> DataFrame:
    """Documents in all, with a generated label, and with gold labels but no generated one."""
    has = gen.select("doc_id", F.lit(1).alias("_g"))
    sides = gold.select("doc_id").distinct().join(has, "doc_id", "left").agg(
        F.count("*").alias("gold_documents"), F.count_if(F.col("_g").isNull()).alias("missing"),
        F.count("_g").alias("common"),
    )
    total, labelled = docs.agg(F.count("*")).scalar(), gen.agg(F.count("*")).scalar()
    return sides.select(
        total.alias("documents"), labelled.alias("labelled"), "gold_documents", "common", "missing",
        (F.lit(100.0) * labelled / total).alias("pct_labelled"),
        (F.lit(100.0) * F.col("missing") / total).alias("pct_missing"),
        (F.col("common") / F.col("gold_documents")).alias("coverage"),
    )


MAX_SUBSET_LABELS = 10
MOST_SUBSET_LABELS = 18  # beyond these the subsets of one signature are more than a task should hold
SUBSET_PLACES = 1 << 20  # label places of subsets that are laid out at a time


def _pairs(n: Column) -> Column:
    """n choose 2, exact for counts beyond what a double holds."""
    d = n.cast("decimal(19,0)")
    return (d * (d - 1) / 2).cast("decimal(38,0)")


def signature_counts(gold: DataFrame, gen: DataFrame) -> DataFrame:
    """Documents by the set of their gold labels and their generated label (NULL for none).

    Everything about pairs follows from this table, which is written once.
    """
    signatures = gold.groupBy("doc_id").agg(F.array_sort(F.collect_set("gold")).alias("labels"))
    named = signatures.join(gen.select("doc_id", F.col("label").alias("gen")), "doc_id", "left")
    return cut_lineage(named.groupBy("labels", "gen").agg(F.count("*").alias("n")))


def _crossed(merged: DataFrame, top: Column) -> DataFrame:
    """Pairs of a large signature and another one, in all and with the same generated label."""
    split = merged.select(
        F.array_intersect("labels", top).alias("held"), F.array_except("labels", top).alias("light"),
        "labels", "gen", "n", "large",
    )
    both = _on_heavy(split).unionByName(_on_light(split))
    return both.agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("every", "same")])


def _heavy_labels(merged: DataFrame, large: DataFrame, k: int) -> DataFrame:
    """One row with the ``k`` labels of large signatures that most signatures hold."""
    used = large.select(F.explode("labels").alias("gold")).distinct()
    held = merged.select(F.explode("labels").alias("gold")).groupBy("gold").agg(F.count("*").alias("held"))
    top = held.join(used, "gold", "left_semi").orderBy(F.desc("held"), "gold").limit(k)
    return top.agg(F.array_sort(F.collect_list("gold")).alias("heavy"))


def _on_heavy(split: DataFrame) -> DataFrame:
    """Pairs with a large signature that share a heavy label: there are at most 2^k sets of these."""
    long, huge = "decimal(19,0)", "decimal(38,0)"
    n, zero = F.col("n").cast(long), F.lit(0).cast(long)
    sets = split.where(F.size("held") > 0).groupBy(F.col("held").alias("labels"), "gen").agg(
        F.sum(F.when(F.col("large"), n).otherwise(zero)).cast(long).alias("l"),
        F.sum(F.when(F.col("large"), zero).otherwise(n)).cast(long).alias("s"),
        F.sum(F.when(F.col("large"), n * n)).cast(huge).alias("itself"),
    )
    twice = (F.col("l") * F.col("l") + 2 * F.col("l") * F.col("s")).cast(huge)
    none = F.array().cast(split.schema["labels"].dataType)
    subsets = F.aggregate("labels", F.array(none), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    by_gen = sets.select(F.explode(subsets).alias("subset"), "gen", "l", "s", "itself").where(F.size("subset") > 0).groupBy("subset", "gen").agg(
        *[F.sum(c).cast(long).alias(c) for c in ("l", "s")], F.coalesce(F.sum("itself"), zero).cast(huge).alias("itself")
    )
    by_subset = by_gen.groupBy("subset").agg(
        *[F.sum(c).cast(long).alias(c) for c in ("l", "s")], F.sum("itself").cast(huge).alias("itself"), F.sum(twice).cast(huge).alias("same"),
    )
    sign = F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)
    half = lambda c: (F.sum(sign * (c - F.col("itself"))) / 2).cast(huge)
    return by_subset.agg(half(twice).alias("every"), half(F.col("same")).alias("same"))


def _on_light(split: DataFrame) -> DataFrame:
    """Pairs with a large signature that share light labels alone, each at its first."""
    side = lambda df, i: df.select(
        F.explode("light").alias("gold"), F.col("held").alias(f"h{i}"), F.col("light").alias(f"t{i}"),
        F.struct("labels", "gen").alias(f"k{i}"), F.col("large").alias(f"large{i}"), F.col("n").cast("decimal(19,0)").alias(f"n{i}"),
    )
    first = F.array_min(F.array_intersect("t1", "t2")) == F.col("gold")
    once = ~F.col("large2") | (F.col("k1") < F.col("k2"))
    weight = (F.col("n1") * F.col("n2")).cast("decimal(38,0)")
    pairs = side(split.where("large"), 1).join(side(split, 2), "gold").where(first & once & ~F.arrays_overlap("h1", "h2"))
    return pairs.agg(
        F.sum(weight).cast("decimal(38,0)").alias("every"), F.sum(F.when(F.col("k1.gen") == F.col("k2.gen"), weight)).cast("decimal(38,0)").alias("same")
    )


def _coded(merged: DataFrame) -> tuple[DataFrame, str]:
    """Labels as sorted numbers, generated labels as numbers, and the numbers' kind.

    Numbers are hashes, the shortest that no two labels share under one of a few seeds.
    """
    names = merged.select(F.explode("labels").alias("x")).distinct(), merged.select(F.col("gen").alias("x")).distinct()
    code = lambda c, bits, seed: F.xxhash64(F.lit(seed), c) if bits == 64 else F.pmod(F.xxhash64(F.lit(seed), c), F.lit(1 << bits))
    for bits, kind in ((8, "uint8"), (16, "uint16"), (32, "uint32"), (64, "int64")):
        tried = range(4)
        found = [d.agg(F.count("*"), *[F.count_distinct(code(F.col("x"), b, s)) for s in tried]).first() for d, b in zip(names, (bits, 64))]
        seeds = [next((s for s in tried if row[s + 1] == row[0]), None) for row in found]
        if None not in seeds:
            labels = F.array_sort(F.transform("labels", lambda x: code(x, bits, seeds[0])))
            return merged.withColumns({"labels": labels, "gen": code(F.col("gen"), 64, seeds[1])}), kind
    raise ValueError("labels whose hashes are equal under every seed")


def _subsets(signatures: DataFrame, kind: str) -> DataFrame:
    """``subset, gen, n``: each non-empty subset of a signature's labels, as the bytes of its numbers."""
    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column("labels")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(kind)
            starts = np.cumsum(sizes) - sizes
            gen, n = batch.column("gen").to_numpy(), batch.column("n").to_numpy()
            for k in np.unique(sizes[sizes > 0]).tolist():
                if k not in members:
                    masks = np.arange(1, 1 << k)
                    chosen = [np.flatnonzero(masks >> j & 1) for j in range(k)]
                    at, which = np.concatenate(chosen), np.repeat(np.arange(k, dtype=np.int8), [len(c) for c in chosen])
                    members[k] = which[np.argsort(at, kind="stable")], np.bincount(at)
                which, lengths = members[k]
                rows = np.flatnonzero(sizes == k)
                step = max(1, SUBSET_PLACES // len(which))
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    data = flat[starts[some][:, None] + np.arange(k)][:, which]
                    ends = np.concatenate([[0], np.cumsum(np.tile(lengths, len(some)) * data.itemsize)]).astype(np.int32)
                    subset = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
                    once = pa.table([subset, *(pa.array(np.repeat(v[some], len(lengths))) for v in (gen, n))], ["subset", "gen", "n"])
                    yield from once.to_batches(max_chunksize=1 << 16)

    return signatures.select("labels", "gen", "n").mapInArrow(emitted, "subset binary, gen long, n long")


def _on_subsets(signatures: DataFrame, kind: str) -> DataFrame:
    """Pairs of documents that share a label, by inclusion and exclusion over subsets of labels."""
    by_gen = _subsets(signatures, kind).groupBy("subset", "gen").agg(F.sum("n").alias("n"))
    several = lambda: F.when(F.col("n") > 1, _pairs(F.col("n")))
    by_subset = by_gen.groupBy("subset").agg(F.sum("n").alias("n"), F.sum(several()).alias("same"))
    sign = F.when(F.octet_length("subset") / np.dtype(kind).itemsize % 2 == 1, 1).otherwise(-1)
    return by_subset.where(F.col("n") > 1).agg(F.sum(sign * several()).alias("every"), F.sum(sign * F.col("same")).alias("same"))


def pair_counts(signatures: DataFrame, max_labels: int = MAX_SUBSET_LABELS, heavy: int = MAX_SUBSET_LABELS) -> DataFrame:
    """Document pairs by same generated label and by sharing a gold label, without listing pairs.

    Documents with the same gold labels are merged first. Pairs that share a label are then
    counted by inclusion and exclusion: each signature adds its count to every non-empty
    subset of its labels, and subsets of odd size count for, those of even size against.
    That costs 2^k rows for a signature of k labels and nothing per pair. Signatures of more
    than ``max_labels`` labels are split into the ``heavy`` labels most signatures hold, for
    which the same counting does, and the light rest: pairs that share no heavy label are met
    on shared light ones, each pair once, at its first. Where a signature would meet more others
    on light labels than it has subsets, it is counted by subsets as well.
    """
    merged, kind = _coded(signatures.where(F.col("gen").isNotNull()))
    wide = merged.where(F.size("labels") > max_labels)
    crossed, own, small = None, None, merged
    if not wide.isEmpty():
        top = _heavy_labels(merged, wide, heavy).first()[0]
        top = F.array(*[F.lit(x) for x in top]).cast("array<bigint>")
        light = wide.select("labels", "gen", F.explode_outer(F.array_except("labels", top)).alias("gold"))
        held = merged.select(F.explode("labels").alias("gold")).groupBy("gold").agg(F.count("*").alias("held"))
        met = light.join(held, "gold", "left").groupBy("labels", "gen").agg(F.coalesce(F.sum("held"), F.lit(0)).alias("met"))
        few = (F.size("labels") > MOST_SUBSET_LABELS) | (F.pow(F.lit(2.0), F.size("labels")) > F.col("met"))
        large = met.where(few).select("labels", "gen", F.lit(True).alias("large"))
        merged = cut_lineage(merged.join(large, ["labels", "gen"], "left").withColumn("large", F.col("large").isNotNull()))
        small, large = merged.where(~F.col("large")), merged.where("large")
        if not large.isEmpty():
            # A large signature against all others: within itself by formula, on heavy labels by subsets, on light ones by join.
            own = large.agg(F.sum(_pairs(F.col("n"))).alias("v"))
            crossed = cut_lineage(_crossed(merged, top))
    shared = cut_lineage(_on_subsets(small, kind))

    clusters = merged.groupBy("gen").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("v"))
    zero = F.lit(0).cast("decimal(38,0)")
    pick = lambda df, c="v": F.coalesce(df.select(c).scalar(), zero)
    more = (lambda c: pick(own) + pick(crossed, c)) if crossed else (lambda c: zero)
    return one_row(signatures).select(
        (pick(shared, "same") + more("same")).alias("same_and_share"),
        (pick(shared, "every") + more("every")).alias("share"),
        pick(clusters).alias("same"),
    )


def one_row(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select()


def pairwise_metrics(
    gold: DataFrame, gen: DataFrame, max_labels: int = MAX_SUBSET_LABELS, heavy: int = MAX_SUBSET_LABELS
) -> DataFrame:
    """Pairwise precision, recall and F1; every document without a generated label is one miss."""
    signatures = signature_counts(gold, gen)
    missing = signatures.where(F.col("gen").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    counts = pair_counts(signatures, max_labels, heavy).withColumn("missing", missing)
    tp, same, share = F.col("same_and_share"), F.col("same"), F.col("share")
    missed = share - tp + F.col("missing")
    d = lambda c: c.cast("double")
    ratio = lambda a, b: F.coalesce(d(a) / F.nullif(d(b), F.lit(0.0)), F.lit(0.0))
    out = counts.select(
        tp.cast("long").alias("true_positive"),
        (same - tp).cast("long").alias("false_positive"),
        missed.cast("long").alias("false_negative"),
        ratio(tp, same).alias("precision"),
        ratio(tp, tp + missed).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))


def contingency(pairs: DataFrame) -> DataFrame:
    """Rows by both labels, written once; all of mutual information follows from it."""
    return cut_lineage(pairs.groupBy("a", "b").agg(F.count("*").alias("n")))


def mutual_information(cells: DataFrame) -> DataFrame:
    """MI and both entropies of two labelings of the same rows, in nats, from their contingency."""
    rows = cells.groupBy("a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n")).scalar().cast("double")
    n, na, nb = F.col("n"), F.col("na"), F.col("nb")
    mi = cells.join(rows, "a").join(cols, "b").agg(
        F.sum(n / total * (F.ln(n) + F.ln(total) - F.ln(na) - F.ln(nb))).alias("v")
    )
    h = lambda df, c: df.agg((-F.sum(c / total * (F.ln(c) - F.ln(total)))).alias("v")).scalar()
    return mi.select(
        F.greatest(F.col("v"), F.lit(0.0)).alias("mi"), h(rows, na).alias("h_a"), h(cols, nb).alias("h_b"),
        total.alias("total"),
    )



def _expected_terms(a: float, b: float, total: float) -> float:
    """Expected contribution to MI of one row total and one column total.

    Overlaps further from their mean than 40 deviations have a probability that a double
    cannot tell from zero, so the sum leaves them out.
    """
    mean = a * b / total
    spread = math.sqrt(max(mean * (1 - a / total) * (1 - b / total) * total / max(total - 1, 1), 0.0))
    low = int(max(1, a + b - total, math.floor(mean - 40 * spread - 60)))
    high = int(min(a, b, math.ceil(mean + 40 * spread + 60)))
    if low > high:
        return 0.0
    n = np.arange(low, high + 1, dtype="float64")
    fixed_part = sum(math.lgamma(x + 1.0) for x in (a, b, total - a, total - b)) - math.lgamma(total + 1.0)
    # One lgamma at the low end, the rest by the ratio of neighbouring probabilities.
    start = fixed_part - sum(math.lgamma(x + 1.0) for x in (low, a - low, b - low, total - a - b + low))
    steps = np.log(a - n[:-1]) + np.log(b - n[:-1]) - np.log(n[1:]) - np.log(total - a - b + n[1:])
    log_p = start + np.concatenate([[0.0], np.cumsum(steps)])
    return float(np.sum(n / total * (np.log(n) + math.log(total) - math.log(a) - math.log(b)) * np.exp(log_p)))


def expected_mutual_information(cells: DataFrame) -> DataFrame:
    """Expected MI of random labelings with the same cluster sizes.

    Only distinct sizes matter. There are at most about sqrt(2N) of them on each side, so
    all combinations together are fewer than the rows they come from.
    """
    def sizes(col: str, out: str) -> DataFrame:
        return cells.groupBy(col).agg(F.sum("n").alias(out)).groupBy(out).agg(F.count("*").alias(f"{out}_k"))

    total = cells.agg(F.sum("n")).scalar()
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = sizes("a", "sa").withColumn("lane", lanes)
    cols = sizes("b", "sb").withColumn("lane", F.pmod(F.xxhash64("sb"), F.lit(parts)).cast("int"))

    @F.pandas_udf(T.DoubleType())
    def term(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_expected_terms(float(x), float(y), float(z)) for x, y, z in zip(a, b, n)])

    combos = rows.join(cols, "lane").withColumn("total", total)
    return combos.agg(
        F.sum(F.col("sa_k") * F.col("sb_k") * term("sa", "sb", "total")).alias("expected_mi")
    )


def ami(pairs: DataFrame) -> DataFrame:
    """Adjusted mutual information of labelings ``a`` and ``b``, arithmetic mean of entropies."""
    cells = contingency(pairs)
    expected = expected_mutual_information(cells).scalar()
    base = mutual_information(cells).withColumn("expected_mi", F.coalesce(expected, F.lit(0.0)))
    mean = (F.col("h_a") + F.col("h_b")) / 2
    room = mean - F.col("expected_mi")
    eps = F.lit(2.220446049250313e-16)
    room = F.when(room < 0, F.least(room, -eps)).otherwise(F.greatest(room, eps))
    single = (F.col("h_a") == 0) & (F.col("h_b") == 0)
    value = F.when(single, F.lit(1.0)).otherwise((F.col("mi") - F.col("expected_mi")) / room)
    return base.withColumn("ami", value)


def label_pairs(gold: DataFrame, gen: DataFrame) -> DataFrame:
    """Rows (document, gold label, generated label) on which the labelings are compared."""
    known = gold.where(F.col("gold").isNotNull()).select("doc_id", F.col("gold").alias("a"))
    return known.join(gen.select("doc_id", F.col("label").alias("b")), "doc_id")


def taxonomy_metrics(docs: DataFrame, gold: DataFrame, gen: DataFrame, source: str) -> DataFrame:
    """Six measures of a taxonomy against one gold source, one row each; labels are written once for all."""
    gold, gen = written(gold, "gold"), written(gen, "generated")
    pair = pairwise_metrics(gold, gen)
    cover = taxonomy_coverage(docs, gold, gen).select("coverage").scalar()
    score = ami(label_pairs(gold, gen)).select("ami").scalar()
    one = pair.select("precision", "recall", "f1").withColumns({"ami": score, "coverage": cover})
    named = {
        "Pairwise Precision": F.col("precision"), "Pairwise Recall": F.col("recall"), "Pairwise F1": F.col("f1"),
        "AMI": F.col("ami"), "Coverage": F.col("coverage"),
        "Coverage-Adjusted AMI": F.when(F.col("coverage") < 1, F.col("ami") * F.col("coverage")).otherwise(0.0),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in named.items()])
    return one.select(F.lit(source).alias("source"), F.explode(entries).alias("e")).select("source", "e.metric", "e.value")


def metric_table(metrics: DataFrame, sources: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Metrics by gold source, side by side."""
    return metrics.groupBy(*by, "metric").pivot("source", list(sources)).agg(F.max("value"))


def exact_match(pairs: DataFrame, target: str, generated: str) -> DataFrame:
    """Target and generated labels with whether they agree."""
    return pairs.select("doc_id", target, generated, (F.col(target) == F.col(generated)).alias("agrees"))


# Positions against external scores ------------------------------------------------------

def tagged(df: DataFrame) -> DataFrame:
    """Each row under the filters it passes: Overall, its party, its chamber."""
    tags = F.array(
        F.lit("Overall"),
        F.when(F.col("party") == "D", "Democrats").when(F.col("party") == "R", "Republicans"),
        F.when(F.col("chamber") == "H", "House").when(F.col("chamber") == "S", "Senate"),
    )
    return df.withColumn("tag", F.explode(F.filter(tags, lambda t: t.isNotNull())))


def large_enough(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Rows of groups of at least ``n``."""
    good = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*by)
    return df.join(good, list(by), "left_semi")


def _two_sided(r: float, n: int) -> float:
    """p-value of a correlation under Student's t with n - 2 degrees of freedom."""
    nu = n - 2
    if nu < 1 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    # With sin^2(phi) = 1 - r^2 the tail is the integral of sin^(nu-1) up to phi, over that to pi/2.
    phi = math.acos(abs(r))
    x, w = np.polynomial.legendre.leggauss(24)
    edges = phi * (1.0 - np.concatenate([0.5 ** np.arange(0, 48), [0.0]]))
    mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
    nodes = mid[:, None] + half[:, None] * x
    values = np.exp((nu - 1) * np.log(np.sin(np.maximum(nodes, 1e-300))))
    tail = float(np.sum(values * w * half[:, None]))
    log_whole = 0.5 * math.log(math.pi) + math.lgamma(nu / 2) - math.lgamma((nu + 1) / 2) - math.log(2)
    return min(1.0, tail / math.exp(log_whole)) if tail > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_two_sided(a, int(b)) for a, b in zip(r, n)])


def pearson_by(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 6) -> DataFrame:
    """Correlation with its p-value per group of at least ``min_n`` rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).where(F.col("n") >= min_n)
    return out.withColumn("p", _p_value("r", "n"))


def rank_both(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    # One row per speaker by now: written once, so that two rankings do not redo what led here.
    df = cut_lineage(df)
    return average_rank(average_rank(df, x, "x_rank", by), y, "y_rank", by)


def spearman_by(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 6) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson_by(rank_both(both, by, x, y), by, "x_rank", "y_rank", min_n)


def rank_shift(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Average ranks on both measures, their distance, and that in percent of the group."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("group_size"))
    ranked = rank_both(df, by, x, y).withColumn("rank_diff", F.abs(F.col("x_rank") - F.col("y_rank")))
    return ranked.join(sizes, list(by)).withColumn(
        "rank_shift_pct", F.lit(100.0) * F.col("rank_diff") / F.col("group_size")
    )


def top_shifts(shifts: DataFrame, by: Sequence[str], order: str, k: int = 10) -> DataFrame:
    """Largest rank shifts per group, in the shape of a report."""
    top = top_per_group(shifts, by, [F.desc("rank_diff"), F.asc(order)], k)
    return top.select(
        *by, "rank",
        text.display_name("bioname").alias("name"), "party", "chamber",
        F.col("x_rank").cast("int").alias("position_rank"), F.col("y_rank").cast("int").alias("external_rank"),
        F.col("rank_diff").cast("int").alias("rank_diff"), F.round("rank_shift_pct", 1).alias("shift_pct"),
    )


def shift_summary(shifts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and median shift per group, in places and in percent of the group."""
    means = shifts.groupBy(*by).agg(F.avg("rank_diff").alias("mean_shift"), F.count("*").alias("n"))
    medians = exact_quantiles(shifts, "rank_diff", {"median_shift": 0.5}, by)
    return means.join(medians, list(by)).withColumns(
        {
            "mean_shift_pct": F.lit(100.0) * F.col("mean_shift") / F.col("n"),
            "median_shift_pct": F.lit(100.0) * F.col("median_shift") / F.col("n"),
        }
    )


def fit_line(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 5) -> DataFrame:
    """Least squares line of ``y`` on ``x`` per group of at least ``min_n`` rows."""
    out = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n")
    )
    return out.where(F.col("n") >= min_n)

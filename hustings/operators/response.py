"""Item response on continuous scores: y = a.theta - b + noise, with priors on all of them.

theta, a and b have N(0,1) priors, the noise's deviation an Exponential(1) one; theta is
integrated out and the rest is at its mode. Three ways lead there:

* all cells count, missing ones as 0: a closed form from the leading directions of the scores;
* only cells that exist count: one job per round. Tasks work out the speakers' posteriors from
  the topics' parameters and add up what the topics need; a quasi-Newton step follows;
* the same with more topics than a task should hold: both halves of a round are joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, stage_path
from .matrix import one_per_cell
from .spectrum import GRAM, directions

TOPICS = 100_000  # topics whose parameters are sent to the tasks; with more they are joined
ROUNDS = 400
MEMORY = 40  # earlier steps that shape the next
RUN = 1 << 16  # cells that are worked on at once
BATCH = 1 << 23  # cells whose bytes are handed on at once


@dataclass
class ItemResponse:
    """Fitted model: ``speakers`` and ``topics`` are tables, the rest is a few numbers.

    ``objective`` is what the fit makes small, after each round; ``rounds`` are the jobs it took
    (none for the closed form).
    """

    dims: int
    speakers: DataFrame
    topics: DataFrame
    sigma2: float
    objective: list[float] = field(default_factory=list)
    rounds: int = 0


def fit_irt(
    cells: DataFrame,
    dims: int = 1,
    zeros: str = "observed",
    tol: float = 1e-7,
    seed: int = 42,
    gram: int = GRAM,
    topics: int = TOPICS,
    rounds: int = ROUNDS,
) -> ItemResponse:
    """Item response of one or two dimensions.

    With ``zeros='observed'`` each missing cell counts as a score of 0, and the fit has a closed
    form; these cells are not written out. With ``'missing'`` rounds go on until a step would
    lessen the objective by no more than ``tol`` squared a speaker; a fit that has not settled
    after ``rounds`` jobs is an error. ``gram`` and ``topics`` bound what the driver and a task
    hold. A null score is no cell, of a cell given several times the largest score counts.
    """
    if dims not in (1, 2):
        raise ValueError("dims has to be 1 or 2")
    if zeros not in ("observed", "missing"):
        raise ValueError(f"unknown zeros: {zeros}")
    if zeros == "observed":
        return _closed_form(cells, dims, gram)
    obs = one_per_cell(cells).select("speaker", "topic", F.col("stance_score").cast("double").alias("y")).where(F.col("y").isNotNull())
    obs = cut_lineage(obs)
    if not obs.limit(1).count():
        raise ValueError("no cells to fit")
    if obs.select("topic").distinct().count() <= topics:
        return _sent_out(obs, dims, tol, seed, rounds)
    return _joined(obs, dims, tol, seed, rounds)


# All cells count --------------------------------------------------------------------------

def _mode(scatter: np.ndarray, means: np.ndarray, rest: float, n: int, m: int, d: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Strengths, difficulties and noise at the mode, along orthonormal directions.

    ``scatter`` are the directions' cross-products around the means over ``n`` speakers,
    ``means`` the topic means along them, ``rest`` the sum of squares around the means off the
    directions. With theta integrated out a row has covariance C = a a' + noise; a lies along the
    leading eigenvectors, with the size c of C along one at the root of c^2 + n c = n value.
    The prior on b leaves the offset mean + b = C (n + C)^-1 mean, which adds its square to the
    scatter; it is small, and put in again until it stands still.
    """
    whole, offset = np.trace(scatter) / n + rest / n, np.zeros(len(means))
    for _ in range(1000):
        values, vectors = np.linalg.eigh(scatter / n + np.outer(offset, offset))
        order = np.argsort(values)[::-1][:d]
        values, vectors = values[order], vectors[:, order]
        sizes = (-n + np.sqrt(n * n + 4 * n * np.maximum(values, 0.0))) / 2
        for live in range(len(values), -1, -1):  # a dimension weaker than the noise has no strength
            left = max(whole + offset @ offset - values[:live].sum(), 1e-12)
            s = math.sqrt(left / max(m - live, 1))
            for _ in range(100):
                f = n * (m - live) * s**2 - n * left - live * s**4 + s**3
                step = f / (2 * n * (m - live) * s - 4 * live * s**3 + 3 * s * s)
                s = max(s - step, s / 2, 1e-9)
                if abs(step) < 1e-15 * s:
                    break
            if live == 0 or sizes[live - 1] > s * s:
                break
        a = np.zeros((len(means), d))
        a[:, :live] = vectors[:, :live] * np.sqrt(sizes[:live] - s * s)
        cov = a @ a.T + s * s * np.eye(len(means))
        moved = cov @ np.linalg.solve(n * np.eye(len(means)) + cov, means)
        if np.abs(moved - offset).max(initial=0.0) <= 1e-15 * (1 + np.abs(means).max(initial=0.0)):
            break
        offset = moved
    return a, moved - means, s * s


def _closed_form(cells: DataFrame, d: int, gram: int) -> ItemResponse:
    found = directions(cells, d, gram=gram)
    n, m = found.speakers, found.topics
    if not n:
        raise ValueError("no cells to fit")
    scatter = found.scatter
    off = max(found.whole - n * found.mean_square - np.trace(scatter), 0.0)
    a, b, sigma2 = _mode(scatter, found.coords, off, n, m, d)
    inner = np.linalg.inv(a.T @ a + sigma2 * np.eye(d))
    al = [f"a{i}" for i in range(d)]
    topics = cut_lineage(found.mixed(np.column_stack([a, b]), [*al, "b"]))
    # Every speaker has the same variance, and as mean the sums over their cells plus those of a b.
    base = a.T @ b
    sums = one_per_cell(cells).join(topics, "topic").groupBy("speaker").agg(
        *[F.coalesce(F.sum(F.col("stance_score") * F.col(x)), F.lit(0.0)).alias(f"r{i}") for i, x in enumerate(al)]
    )
    means = [sum((F.lit(float(inner[i, j])) * (F.col(f"r{j}") + F.lit(float(base[j]))) for j in range(d)), F.lit(0.0)).alias(f"t{i}") for i in range(d)]
    spread = [F.lit(float(sigma2 * inner[i, j])).alias(f"v{i}{j}") for i in range(d) for j in range(i, d)]
    theta = cut_lineage(sums.select("speaker", *means, *spread))
    # Variances of the topics' parameters under the second moments of theta.
    second = _numbers(theta.withColumn("minus", F.lit(-1.0)), _theta_moments(d, False))
    square = np.zeros((d + 1, d + 1))
    for i in range(d + 1):
        for j in range(i, d + 1):
            square[i, j] = square[j, i] = second[f"m{i}{j}"] + (second[f"s{i}{j}"] if j < d else 0.0)
    var = sigma2 * np.diag(np.linalg.inv(square + sigma2 * np.eye(d + 1)))
    items = topics.select("*", *[F.lit(float(v)).alias(f"var_{x}") for v, x in zip(var, [*al, "b"])])
    return _identified(theta, items, d, sigma2, [], 0)


# Only existing cells count ------------------------------------------------------------------

def _posteriors(flat: np.ndarray, y: np.ndarray, edges: np.ndarray, params: np.ndarray, sigma2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, variances, scaled sums along a and log determinants of the precisions of theta for runs of cells.

    ``params`` has a row for each strength and one for the difficulty.
    """
    d, n = len(params) - 1, len(edges)
    a, shifted = [params[i][flat] for i in range(d)], y + params[d][flat]
    precision, along = np.empty((n, d, d)), np.empty((n, d))
    for i in range(d):
        along[:, i] = np.add.reduceat(a[i] * shifted, edges) / sigma2
        for j in range(i, d):
            precision[:, i, j] = precision[:, j, i] = np.add.reduceat(a[i] * a[j], edges) / sigma2 + (i == j)
    spread = np.linalg.inv(precision)
    return np.einsum("nij,nj->ni", spread, along), spread, along, np.linalg.slogdet(precision)[1]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each speaker's list of cells as the bytes of its places and scores, no more of these in a batch than ``BATCH``."""
    for batch in batches:
        cells = batch.column("c")
        flat, sizes = cells.flatten(), cells.value_lengths().to_numpy(zero_copy_only=False)
        places = np.ascontiguousarray(flat.field("place").to_numpy(zero_copy_only=False), np.int32)
        scores = np.ascontiguousarray(flat.field("y").to_numpy(zero_copy_only=False), np.float64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        for low, high in _cuts(ends, BATCH):
            within = ends[low : high + 1] - ends[low]
            columns = [
                pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((within * v.itemsize).astype(np.int32)), pa.py_buffer(v[ends[low] : ends[high]])])
                for v in (places, scores)
            ]
            yield pa.record_batch([batch.column("speaker").slice(low, high - low), *columns], ["speaker", "places", "scores"])


def _cuts(ends: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Runs of speakers of at most so many cells, or one speaker, by where their cells end."""
    low = 0
    while low < len(ends) - 1:
        high = max(int(np.searchsorted(ends, ends[low] + cells, side="right")) - 1, low + 1)
        yield low, high
        low = high


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers whose bytes a column holds, without a copy, and where those of each row end."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind), (ends - ends[0]) // size


class _Rounds:
    """Cells by speaker, and the job that takes parameters to the objective and topic sums."""

    def __init__(self, obs: DataFrame, d: int):
        self.d, spark = d, obs.sparkSession
        y = F.col("y")
        found = obs.groupBy("topic").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(y * y).alias("q")).collect()
        found = sorted(found, key=lambda r: r.topic)
        self.topics = [r.topic for r in found]
        kind = obs.schema["topic"].dataType
        schema = obs.select("topic").schema.add("place", "integer")
        self.kind, self.m = kind, len(self.topics)
        # What does not change from round to round, of the cells that are met below: those of a topic that is not null.
        self.cells, self.scores, self.met = (np.array([r[c] if r.topic is not None else 0.0 for r in found], float) for c in "nsq")
        self.squares = float(sum(r.q for r in found))
        places = spark.createDataFrame([(t, i) for i, t in enumerate(self.topics)], schema)
        rows = obs.join(F.broadcast(places), "topic").groupBy("speaker").agg(F.collect_list(F.struct("place", "y")).alias("c"))
        self.speaker = obs.schema["speaker"].dataType.simpleString()
        path = stage_path(spark, "responses")
        rows.mapInArrow(_packed, f"speaker {self.speaker}, places binary, scores binary").write.parquet(path)
        self.rows = spark.read.parquet(path)
        facts = obs.agg(F.count("*"), F.count_distinct("speaker"), F.avg("y"), F.var_pop("y")).first()
        self.n_obs, self.n, self.mean, self.variance = facts[0], facts[1], facts[2], facts[3] or 0.0

    @staticmethod
    def _flat(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of speakers: how many, their cells' places and scores, and where each one's start."""
        if not batch.num_rows:
            return
        flat, ends = _unpacked(batch.column("places"), np.int32)
        y, _ = _unpacked(batch.column("scores"), np.float64)
        for low, high in _cuts(ends, RUN):
            yield high - low, flat[ends[low] : ends[high]].astype(np.intp), y[ends[low] : ends[high]], ends[low:high] - ends[low]

    def sums(self, params: np.ndarray, sigma2: float) -> tuple[np.ndarray, float]:
        """Per topic: theta's second moments with -1, and products with y; and the objective's share of the speakers."""
        d, m = self.d, self.m
        sent = self.rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(params.T))
        flat_of = self._flat
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        names = [f"s{k}" for k in range(len(pairs) + 2 * d)]

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = sent.value
            total, cost = np.zeros((len(names), m)), 0.0
            for batch in batches:
                for _, flat, y, edges in flat_of(batch):
                    means, spread, along, logdet = _posteriors(flat, y, edges, p, sigma2)
                    # -2 log density of a speaker's cells, theta integrated out, less what the scores alone give.
                    cost += logdet.sum() - np.einsum("ni,ni->", along, means)
                    sizes = np.diff(np.append(edges, len(flat)))
                    mine = [np.repeat(means[:, i], sizes) for i in range(d)]
                    parts = [np.repeat(means[:, i] * means[:, j] + spread[:, i, j], sizes) for i, j in pairs]
                    for k, part in enumerate([*parts, *mine, *[x * y for x in mine]]):
                        total[k] += np.bincount(flat, weights=part, minlength=m)
            used = np.flatnonzero(total.any(axis=0))
            yield pa.record_batch(
                [pa.array(np.append(used, -1).astype(np.int32))] + [pa.array(np.append(total[k, used], cost if k == 0 else 0.0)) for k in range(len(names))],
                ["place", *names],
            )

        parts = self.rows.select("places", "scores").mapInArrow(added, "place int, " + ", ".join(f"{c} double" for c in names))
        got = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        place = got.column("place").to_numpy()
        values = np.column_stack([got.column(c).to_numpy() for c in names])
        sent.unpersist()
        found = np.zeros((m, len(names)))
        found[place[place >= 0]] = values[place >= 0]
        second, right = np.zeros((m, d + 1, d + 1)), np.zeros((m, d + 1))
        for k, (i, j) in enumerate(pairs):
            second[:, i, j] = second[:, j, i] = found[:, k]
        for i in range(d):
            second[:, i, d] = second[:, d, i] = -found[:, len(pairs) + i]
            right[:, i] = found[:, len(pairs) + d + i]
        second[:, d, d], right[:, d] = self.cells, -self.scores
        b = params[:, d]
        shifted = self.met.sum() + 2 * (b @ self.scores) + (b * b) @ self.cells  # squares of y + b
        return np.column_stack([second.reshape(m, -1), right]), float(values[place < 0, 0].sum()) + shifted / sigma2

    def speakers(self, params: np.ndarray, sigma2: float) -> DataFrame:
        d, flat_of = self.d, self._flat
        sent = self.rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(params.T))
        names = [*[f"t{i}" for i in range(d)], *[f"v{i}{j}" for i in range(d) for j in range(i, d)]]

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for n, flat, y, edges in flat_of(batch):
                    means, spread, _, _ = _posteriors(flat, y, edges, sent.value, sigma2)
                    columns = [*means.T, *[spread[:, i, j] for i in range(d) for j in range(i, d)]]
                    yield pa.record_batch([batch.column("speaker").slice(at, n), *[pa.array(c.copy()) for c in columns]], ["speaker", *names])
                    at += n

        return cut_lineage(self.rows.mapInArrow(placed, f"speaker {self.speaker}, " + ", ".join(f"{c} double" for c in names)))


class _Point:
    """Objective, slope and the complete data's curvature at some parameters, out of one job."""

    def __init__(self, work: _Rounds, x: np.ndarray):
        d, m = work.d, work.m
        self.x = x
        params, sigma2 = x[:-1].reshape(m, d + 1), math.exp(2 * min(x[-1], 300.0))
        got, cost = work.sums(params, sigma2)
        s = math.sqrt(sigma2)
        second, right = got[:, : (d + 1) ** 2].reshape(m, d + 1, d + 1), got[:, (d + 1) ** 2 :]
        self.value = 0.5 * (cost + work.n_obs * math.log(2 * math.pi * sigma2) + (params**2).sum()) + s
        self.second = second / sigma2 + np.eye(d + 1)
        slope = (np.einsum("mij,mj->mi", second, params) - right) / sigma2 + params
        # Squared error at the expected theta, from the same sums.
        error = work.squares - 2 * np.einsum("mi,mi->", params, right) + np.einsum("mi,mij,mj->", params, second, params)
        self.slope = np.append(slope.ravel(), work.n_obs - error / sigma2 + s)
        self.weight = 2 * error / sigma2 + s  # curvature in log sigma
        self.shape = (m, d + 1)

    def solved(self, g: np.ndarray) -> np.ndarray:
        """What the step of an expectation-maximisation round would be for a slope."""
        inner = np.linalg.solve(self.second, g[:-1].reshape(self.shape)[:, :, None])[:, :, 0]
        return np.append(inner.ravel(), g[-1] / self.weight)


def _ahead(point: _Point, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton step from earlier moves and slope changes, on the curvature of the complete data."""
    q, used = point.slope.copy(), []
    for s, y in reversed(steps):
        rho = 1.0 / (y @ s)
        alpha = rho * (s @ q)
        q -= alpha * y
        used.append((rho, alpha, s, y))
    r = point.solved(q)
    for rho, alpha, s, y in reversed(used):
        r += s * (alpha - rho * (y @ r))
    return -r


def _sent_out(obs: DataFrame, d: int, tol: float, seed: int, rounds: int) -> ItemResponse:
    work = _Rounds(obs, d)
    spread = math.sqrt(max(work.variance, 1e-8))
    rng = np.random.default_rng(seed)
    start = np.zeros((work.m, d + 1))
    start[:, :d] = rng.normal(size=(work.m, d)) * spread * 0.5
    start[:, d] = -work.mean
    point = _Point(work, np.append(start.ravel(), math.log(spread)))
    history, steps, jobs, stretch = [point.value], [], 1, 1.0
    while True:
        simple = point.solved(point.slope)
        if point.slope @ simple <= tol * tol * work.n:
            break
        step = _ahead(point, steps)
        if point.slope @ step >= 0:
            step, steps = -simple, []
        stretch = 1.0
        while True:
            if jobs >= rounds:
                raise RuntimeError(f"item response did not settle in {rounds} rounds")
            after, jobs = _Point(work, point.x + stretch * step), jobs + 1
            if after.value <= point.value + 1e-4 * stretch * (point.slope @ step) + 1e-12 * abs(point.value):
                break
            stretch /= 4
            if stretch < 1e-3:  # the plain step never makes the objective worse
                step, steps, stretch = -simple, [], 1.0
        moved, turned = after.x - point.x, after.slope - point.slope
        if moved @ turned > 1e-12 * math.sqrt((moved @ moved) * (turned @ turned)):
            steps = [*steps, (moved, turned)][-MEMORY:]
        point = after
        history.append(point.value)
    params, sigma2 = point.x[:-1].reshape(work.m, d + 1), math.exp(2 * point.x[-1])
    var = np.einsum("mii->mi", np.linalg.inv(point.second))
    names = [*[f"a{i}" for i in range(d)], "b"]
    rows = [(t, *map(float, p), *map(float, v)) for t, p, v in zip(work.topics, params, var)]
    schema = obs.select("topic").schema
    for name in [*names, *[f"var_{x}" for x in names]]:
        schema = schema.add(name, "double")
    items = obs.sparkSession.createDataFrame(rows, schema)
    return _identified(work.speakers(params, sigma2), items, d, sigma2, history, jobs)


# Only existing cells count, more topics than a task should hold -------------------------------

def _joined(obs: DataFrame, d: int, tol: float, seed: int, rounds: int) -> ItemResponse:
    """Each round gives every topic its ridge solution under the current speakers, then the
    noise, then every speaker the mean and variance of theta: a join of the cells with a
    parameter table and an aggregation that combines on the map side, twice. After every three
    rounds theta is carried on along its path by squared extrapolation; where that makes the
    objective worse it is taken back.
    """
    th = [f"t{i}" for i in range(d)]
    everyone = cut_lineage(obs.select("speaker").distinct())
    everything = cut_lineage(obs.select("topic").distinct())
    n_speakers = everyone.count()
    base = _numbers(obs, {"n": F.count("*"), "s": F.sum("y"), "q": F.sum(F.col("y") * F.col("y"))})
    n_obs = base["n"]
    sigma2 = max(base["q"] / n_obs - (base["s"] / n_obs) ** 2, 1e-8)

    def start(i: int) -> Column:
        h = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:{i}:"), F.col("speaker").cast("string"))), F.lit(8)), 16, 10)
        return h.cast("double") / float(1 << 31) - 1.0

    theta = cut_lineage(everyone.select(
        "speaker", *[start(i).alias(th[i]) for i in range(d)],
        *[F.lit(0.0).alias(f"v{i}{j}") for i in range(d) for j in range(i, d)],
    ))
    history: list[float] = []
    path: list[DataFrame] = []
    held: DataFrame | None = None
    for done in range(rounds):
        known = bool(path or held is not None)
        moments = _numbers(theta.withColumn("minus", F.lit(-1.0)), _theta_moments(d, known))
        items = _topic_step(obs, theta, everything, d, sigma2)
        totals = _numbers(items, _topic_totals(d))
        ssr = max(base["q"] + totals["e"], 1e-12)
        noise = _noise(ssr, n_obs)
        size = {i: moments[f"m{i}{i}"] + moments[f"s{i}{i}"] for i in range(d)}
        stretch = {i: _stretch(size[i], totals[f"m{i}{i}"], n_speakers) for i in range(d)}
        cost = moments.get("h", 0.0) + sum(
            (c * c - 1) * size[i] / 2 - n_speakers * math.log(c) for i, c in stretch.items()
        )
        items, totals = _rescaled(items, totals, stretch)
        if known:
            value = (
                n_obs / 2 * math.log(2 * math.pi * noise) + ssr / (2 * noise) + math.sqrt(noise)
                + totals["p"] / 2 + cost
            )
            if held is not None and not path and value > history[-1] + 1e-9 * abs(history[-1]):
                theta, path = held, [held]
                continue
            history.append(value)
        sigma2 = noise
        theta = _speaker_step(obs, items, everyone, d, sigma2)
        path.append(theta)
        if len(path) == 3:
            held, (theta, moved) = theta, _carried_on(path, th)
            path = []
            if moved <= max(tol, 1e-5):
                return _identified(held, items, d, sigma2, history, done + 1)
    raise RuntimeError(f"item response did not settle in {rounds} rounds")


def _inverse(m: list[list[Column]]) -> tuple[list[list[Column]], Column]:
    """Inverse and determinant of a symmetric matrix of columns, up to 3 by 3."""
    n = len(m)
    if n == 1:
        return [[F.lit(1.0) / m[0][0]]], m[0][0]
    if n == 2:
        det = m[0][0] * m[1][1] - m[0][1] * m[0][1]
        return [[m[1][1] / det, -m[0][1] / det], [-m[0][1] / det, m[0][0] / det]], det
    (a, b, c), (_, d, e), (_, _, f) = m
    co = [[d * f - e * e, c * e - b * f, b * e - c * d], [None, a * f - c * c, b * c - a * e], [None, None, a * d - b * b]]
    det = a * co[0][0] + b * co[0][1] + c * co[0][2]
    return [[co[min(i, j)][max(i, j)] / det for j in range(3)] for i in range(3)], det


def _outer(prefix: str, names: Sequence[str]) -> dict[str, Column]:
    """Sums of all products of the named columns."""
    return {
        f"{prefix}{i}{j}": F.sum(F.col(names[i]) * F.col(names[j]))
        for i in range(len(names))
        for j in range(i, len(names))
    }


def _sym(prefix: str, n: int) -> list[list[Column]]:
    return [[F.col(f"{prefix}{min(i, j)}{max(i, j)}") for j in range(n)] for i in range(n)]


def _numbers(df: DataFrame, aggs: dict[str, Column]) -> dict[str, float]:
    row = df.agg(*[c.alias(n) for n, c in aggs.items()]).first()
    return {n: float(row[n] or 0.0) for n in aggs}


def _carried_on(path: list[DataFrame], th: Sequence[str]) -> tuple[DataFrame, float]:
    """Theta extrapolated from three states in a row, and how far the last round moved it for its size."""
    names = [t for t in path[0].columns if t != "speaker"]
    both = path[2]
    for k in (0, 1):
        both = both.join(path[k].select("speaker", *[F.col(t).alias(f"_{t}_{k}") for t in th]), "speaker")
    first = {t: F.col(f"_{t}_1") - F.col(f"_{t}_0") for t in th}
    bend = {t: F.col(t) - 2 * F.col(f"_{t}_1") + F.col(f"_{t}_0") for t in th}
    square = lambda cols: F.sum(reduce(lambda a, b: a + b, [c * c for c in cols]))
    n = _numbers(both, {
        "r": square(first.values()), "v": square(bend.values()), "size": square(F.col(t) for t in th),
        "last": square(F.col(t) - F.col(f"_{t}_1") for t in th),
    })
    step = max(1.0, math.sqrt(n["r"] / n["v"])) if n["v"] > 0 else 1.0
    ahead = {t: F.col(f"_{t}_0") + 2 * step * first[t] + step * step * bend[t] for t in th}
    out = both.select("speaker", *[ahead.get(t, F.col(t)).alias(t) for t in names])
    return cut_lineage(out), math.sqrt(n["last"] / max(n["size"], 1e-300))


def _stretch(size: float, strength: float, n: int) -> float:
    """Factor on theta (and its inverse on a) that suits both priors best; the fit does not feel it.

    Without it the scale, which the data leave open, would creep to its place round by round.
    """
    return math.sqrt((n + math.sqrt(n * n + 4 * size * strength)) / (2 * size)) if size > 0 else 1.0


def _rescaled(items: DataFrame, totals: dict[str, float], stretch: dict[int, float]) -> tuple[DataFrame, dict[str, float]]:
    d = len(stretch)
    items = items.withColumns(
        {f"a{i}": F.col(f"a{i}") / c for i, c in stretch.items()}
        | {f"var_a{i}": F.col(f"var_a{i}") / (c * c) for i, c in stretch.items()}
    )
    out = dict(totals)
    out["p"] += sum(totals[f"m{i}{i}"] * (1 / (c * c) - 1) for i, c in stretch.items())
    for i in range(d):
        for j in range(i, d):
            out[f"m{i}{j}"] = totals[f"m{i}{j}"] / (stretch[i] * stretch[j])
    return items, out


def _theta_moments(d: int, cost: bool) -> dict[str, Column]:
    x = [*[f"t{i}" for i in range(d)], "minus"]
    spread = {f"s{i}{j}": F.sum(f"v{i}{j}") for i in range(d) for j in range(i, d)}
    return _outer("m", x) | spread | ({"h": _theta_cost(d)} if cost else {})


def _topic_totals(d: int) -> dict[str, Column]:
    """Sums over all topics: error beyond the sum of squares, prior, and products of parameters."""
    al = [f"a{i}" for i in range(d)]
    names = [*al, "b"]
    quad = sum(
        (F.col(names[i]) * F.col(names[j]) * F.col(f"g{min(i, j)}{max(i, j)}") for i in range(d + 1) for j in range(d + 1)),
        F.lit(0.0),
    )
    lin = sum((F.col(names[i]) * F.col(f"r{i}") for i in range(d + 1)), F.lit(0.0))
    prior = sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))
    return {"e": F.sum(quad - 2 * lin), "p": F.sum(prior)} | _outer("m", al)


def _theta_cost(d: int) -> Column:
    """Half of E|theta|^2 - ln|V| - d per speaker: distance of its distribution from the prior."""
    spread = sum((F.col(f"v{i}{i}") for i in range(1, d)), F.col("v00"))
    size = sum((F.col(f"t{i}") * F.col(f"t{i}") for i in range(1, d)), F.col("t0") * F.col("t0"))
    det = F.col("v00") if d == 1 else F.col("v00") * F.col("v11") - F.col("v01") * F.col("v01")
    return F.sum((size + spread - F.ln(det) - F.lit(float(d))) / 2)


def _noise(ssr: float, n: float) -> float:
    """Mode of the noise under an Exponential(1) prior: s^3 + n s^2 = ssr, by Newton's method."""
    s = math.sqrt(max(ssr, 1e-300) / n)
    for _ in range(50):
        step = (s**3 + n * s * s - ssr) / (3 * s * s + 2 * n * s)
        s = max(s - step, 1e-12)
        if abs(step) < 1e-14:
            break
    return s * s


def _topic_step(obs, theta, everything, d, sigma2):
    """Ridge solution (a, b) of each topic with its variances."""
    th, al = [f"t{i}" for i in range(d)], [f"a{i}" for i in range(d)]
    x = [*th, "minus"]
    joined = obs.join(theta, "speaker").withColumn("minus", F.lit(-1.0))
    sums = {f"r{i}": F.sum(F.col("y") * F.col(x[i])) for i in range(d + 1)}
    sums |= _theta_moments(d, False)
    per = joined.groupBy("topic").agg(*[c.alias(n) for n, c in sums.items()])
    per = everything.join(per, "topic", "left").na.fill(0.0)
    second = _sym("m", d + 1)
    for i in range(d):
        for j in range(d):
            second[i][j] = second[i][j] + F.col(f"s{min(i, j)}{max(i, j)}")
    ridge = [[second[i][j] + (F.lit(sigma2) if i == j else F.lit(0.0)) for j in range(d + 1)] for i in range(d + 1)]
    inv, _ = _inverse(ridge)
    r = [F.col(f"r{i}") for i in range(d + 1)]
    beta = [sum((inv[i][j] * r[j] for j in range(1, d + 1)), inv[i][0] * r[0]) for i in range(d + 1)]
    names = [*al, "b"]
    solved = per.select(
        "topic", *r,
        *[beta[i].alias(names[i]) for i in range(d + 1)],
        *[(F.lit(sigma2) * inv[i][i]).alias(f"var_{names[i]}") for i in range(d + 1)],
        *[second[i][j].alias(f"g{i}{j}") for i in range(d + 1) for j in range(i, d + 1)],
    )
    return cut_lineage(solved)


def _speaker_step(obs, items, everyone, d, sigma2):
    """Mean and variance of theta of each speaker under the current topics."""
    al = [f"a{i}" for i in range(d)]
    joined = obs.join(items.select("topic", *al, "b"), "topic")
    target = F.col("y") + F.col("b")
    sums = {f"r{i}": F.sum(F.col(al[i]) * target) for i in range(d)}
    sums |= _outer("m", al)
    per = joined.groupBy("speaker").agg(*[c.alias(n) for n, c in sums.items()])
    per = everyone.join(per, "speaker", "left").na.fill(0.0)
    m = _sym("m", d)
    ridge = [[m[i][j] + (F.lit(sigma2) if i == j else F.lit(0.0)) for j in range(d)] for i in range(d)]
    inv, _ = _inverse(ridge)
    means = [sum((inv[i][j] * F.col(f"r{j}") for j in range(1, d)), inv[i][0] * F.col("r0")) for i in range(d)]
    out = per.select(
        "speaker", *[means[i].alias(f"t{i}") for i in range(d)],
        *[(F.lit(sigma2) * inv[i][j]).alias(f"v{i}{j}") for i in range(d) for j in range(i, d)],
    )
    return cut_lineage(out)


# Results --------------------------------------------------------------------------------------

def _identified(theta, items, d, sigma2, history, rounds) -> ItemResponse:
    """Turn to principal axes of theta and make each dimension's strongest topic positive."""
    turn = np.eye(d)
    if d == 2:
        s = _numbers(theta, {"xx": F.covar_pop("t0", "t0"), "xy": F.covar_pop("t0", "t1"), "yy": F.covar_pop("t1", "t1")})
        _, vecs = np.linalg.eigh(np.array([[s["xx"], s["xy"]], [s["xy"], s["yy"]]]))
        turn = vecs[:, ::-1]

    def turned(names: Sequence[str]) -> list[Column]:
        return [sum((F.col(names[j]) * F.lit(float(turn[j, i])) for j in range(d)), F.lit(0.0)) for i in range(d)]

    a_names, t_names = [f"a{i}" for i in range(d)], [f"t{i}" for i in range(d)]
    rotated = items.withColumns(dict(zip(a_names, turned(a_names))))
    top = rotated.agg(
        *[F.min_by(a, F.struct((-F.abs(F.col(a))).alias("_s"), F.col("topic"))).alias(a) for a in a_names]
    ).first()
    sign = [-1.0 if (top[a] or 0.0) < 0 else 1.0 for a in a_names]
    spread = {}
    for i in range(d):
        var = sum(
            (F.col(f"v{min(p, q)}{max(p, q)}") * F.lit(float(turn[p, i] * turn[q, i])) for p in range(d) for q in range(d)),
            F.lit(0.0),
        )
        spread[f"sd{i}"] = F.sqrt(F.greatest(var, F.lit(0.0)))
    speakers = theta.select(
        "speaker", *[(c * sign[i]).alias(t_names[i]) for i, c in enumerate(turned(t_names))],
        *[c.alias(n) for n, c in spread.items()],
    )
    topics = rotated.select(
        "topic", *[(F.col(a) * sign[i]).alias(a) for i, a in enumerate(a_names)], "b",
        *[f"var_{a}" for a in a_names], "var_b",
    )
    return ItemResponse(d, speakers, topics, sigma2, history, rounds)


Z = 1.96


def position_tables(
    model: ItemResponse, chambers: DataFrame | None = None, parties: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Result tables of a one-dimensional fit: positions, uncertainty, discrimination, parameters."""
    def bounds(value: Column, sd: Column) -> tuple[Column, Column]:
        return value - Z * sd, value + Z * sd

    low, high = bounds(F.col("t0"), F.col("sd0"))
    points = model.speakers.select(
        "speaker", F.col("t0").alias("ideal_point_mean"), low.alias("ideal_point_lower"), high.alias("ideal_point_upper")
    )
    if chambers is not None:
        points = points.join(chambers, "speaker", "left")
    if parties is not None:
        points = points.join(parties, "speaker", "left").withColumn("party", F.coalesce("party", F.lit("UNK")))
    a_low, a_high = bounds(F.col("a0"), F.sqrt("var_a0"))
    b_low, b_high = bounds(F.col("b"), F.sqrt("var_b"))
    params = model.topics.select(
        "topic",
        F.col("a0").alias("alpha_discrimination_mean"), a_low.alias("alpha_discrimination_lower"),
        a_high.alias("alpha_discrimination_upper"), F.col("b").alias("beta_difficulty_mean"),
        b_low.alias("beta_difficulty_lower"), b_high.alias("beta_difficulty_upper"),
    )
    strength = params.select(
        "topic", "alpha_discrimination_mean", F.abs("alpha_discrimination_mean").alias("abs_discrimination")
    )
    return {
        "positions": points.orderBy(F.desc("ideal_point_mean"), "speaker"),
        "uncertainty": points.withColumnsRenamed(
            {"ideal_point_lower": "95%_theta_lower", "ideal_point_mean": "theta_mean", "ideal_point_upper": "95%_theta_upper"}
        ).orderBy("theta_mean", "speaker"),
        "discrimination": strength.orderBy(F.desc("abs_discrimination"), "topic"),
        "parameters": params.orderBy("topic"),
    }

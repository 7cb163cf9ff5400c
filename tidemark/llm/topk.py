"""Exact top-k inner products with a pivot-distance index.

Vectors are parted into bands of nearly equal norm. Within a band inner products
become distances by one more coordinate: with M the band's largest squared norm, x
gets sqrt(M - |x|^2) and a query 0, and |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest
are those of the highest scores. Each vector is keyed by its nearest pivot of its band
and the distance to it; the index is a table in that order, cut into segments
(annuli of a pivot), so a pivot that attracts a third of all vectors just has many
segments, and equal vectors are parted by their ids. Because the table is sorted by
the key, its Parquet statistics let a scan skip annuli.

Queries pass in slabs of bounded bytes, which are broadcast; vectors are never joined
or copied for each query. A slab begins with bounds from a sample of the vectors, then
widens its annuli: each step scans the annuli that meet [d(q, p) - R, d(q, p) + R] and
weren't met before, and the k-th score so far shrinks the radius r beyond which the
triangle inequality leaves nothing. It stops when R has reached r. Whole bands go by
|q| |x| < k-th score. Scores are integers and exact (Python's integers where 53 bits
don't hold them); distances only prune, with a margin.

Pivots are means of clusters of a bounded, hashed sample (``Index.sample`` vectors);
every vector is indexed. Edge cases: vectors that are null or hold a null or non-finite
component take no part; null ids neither; shorter vectors, empty ones too, count as
padded by zeros; ties go to the smaller id; fewer candidates than k give fewer rows;
rows of one id are one query, whose list holds the scores of all of them, and never
candidates of each other; scores beyond 64 bits count as its ends; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path


@dataclass(frozen=True)
class Index:
    pivots: int = 48
    sample: int = 4_096
    #: Vectors of a segment.
    segment: int = 2_048
    #: Bytes of the queries that are broadcast at once, as doubles.
    slab: int = 32_000_000
    #: Shares of the radius that a slab searches one after another; the last is 1.
    steps: tuple[float, ...] = (0.5, 1.0)


_LONG = (1 << 63) - 1
_EXACT = float(1 << 53)


def measure(rows: DataFrame, scale: int) -> DataFrame:
    """Adds ``band``, a fourth of a power of two of the norm of scale * x wide, and ``log``,
    log2 of that norm (-1 for less than a half); both null where the vector takes no part."""

    @F.arrow_udf("band int, log double")
    def run(col: pa.Array) -> pa.Array:
        lengths = pc.fill_null(col.value_lengths(), 0).to_numpy(zero_copy_only=False)
        x = np.abs(col.flatten().to_numpy(zero_copy_only=False).astype(float))  # a null is nan
        own = np.repeat(np.arange(len(col)), lengths)
        bad = (np.bincount(own, ~np.isfinite(x), len(col)) > 0) | col.is_null().to_numpy(zero_copy_only=False)
        most = np.zeros(len(col))
        np.maximum.at(most, own, np.where(np.isfinite(x), x, 0))
        with np.errstate(all="ignore"):
            square = np.bincount(own, (x / most[own]) ** 2, len(col))
            log = np.where(most > 0, np.maximum(np.log2(most) + np.log2(square) / 2 + np.log2(scale), -1.0), -1.0)
        return pa.StructArray.from_arrays([pa.array(np.where(bad, 0, np.floor(4 * log)).astype(np.int32), mask=bad), pa.array(log, mask=bad)], names=["band", "log"])

    return rows.withColumn("m", run("v")).select("vec_id", "v", "m.band", "m.log")


def _matrix(col: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of doubles, padded with zeros."""
    n = len(col)
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if n and (lengths == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims))
    out[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): whole doubles where all fit 53 bits, else Python's integers."""
    with np.errstate(over="ignore"):
        v = np.floor(scale * x)
    if not v.size or np.abs(v).max() < _EXACT:
        return v
    return np.array([[int(c) if abs(c) < _EXACT else int(e) * scale for c, e in zip(r, s, strict=True)] for r, s in zip(v.tolist(), x.tolist(), strict=True)], object)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as exact 64-bit integers, at its ends where they don't fit."""
    plain = q.dtype != object and x.dtype != object
    if plain and (not q.size or not x.size or q.shape[1] * np.abs(q).max() * np.abs(x).max() < _EXACT):
        return (q @ x.T).astype(np.int64)
    whole = lambda m: m if m.dtype == object else np.array([[int(e) for e in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -_LONG - 1, _LONG).astype(np.int64)


def lift(v: np.ndarray, most: float) -> np.ndarray:
    """One more coordinate, which turns inner products into distances; a query's is 0."""
    return np.column_stack([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0.0))


def centres(points: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Means of ``n`` clusters, begun from rows far from each other."""
    d = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(d.argmax())]
    d = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    mid = points[chosen]
    for _ in range(rounds):
        own = distances(points, mid).argmin(axis=1)
        held = np.bincount(own, minlength=len(mid))
        total = np.zeros_like(mid)
        np.add.at(total, own, points)
        mid = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], mid)
    return mid


@dataclass(frozen=True)
class Bands:
    """What a task needs of the index: a row of ``pivots`` for each pivot, its band's
    number, largest squared norm, and where each band's pivots begin."""

    dims: int
    scale: int
    begin: dict[int, tuple[int, int]]
    most: dict[int, float]
    pivots: np.ndarray


def pick_pivots(bands: dict[int, float], points: np.ndarray, of: np.ndarray, how: Index, dims: int, scale: int) -> Bands:
    """Pivots of each band by its share of the sample; the origin where it has none."""
    begin, rows, at = {}, [], 0
    with np.errstate(over="ignore", invalid="ignore"):
        for band, most in bands.items():
            own = lift(points[of == band], most)
            own = own[np.isfinite(own).all(axis=1)]
            mine = centres(own, max(1, round(how.pivots * len(own) / max(len(points), 1)))) if len(own) else np.zeros((1, dims + 1))
            begin[band] = (at, at + len(mine))
            rows.append(mine)
            at += len(mine)
    return Bands(dims, scale, begin, dict(bands), np.concatenate(rows))


def key(rows: DataFrame, shared) -> DataFrame:
    """Adds the nearest pivot of the band and the distance to it (0 where it overflows)."""

    @F.arrow_udf("pivot int, dist double")
    def assign(v: pa.Array, band: pa.Array) -> pa.Array:
        known, of = shared.value, band.to_numpy()
        pivot, dist = np.zeros(len(of), np.int32), np.zeros(len(of))
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(known.scale * _matrix(v, known.dims))
            for b in np.unique(of).tolist():
                at, (i, j) = np.flatnonzero(of == b), known.begin[b]
                d = np.nan_to_num(distances(lift(x[at], known.most[b]), known.pivots[i:j]), nan=0.0, posinf=0.0)
                near = d.argmin(axis=1)
                pivot[at], dist[at] = i + near, d[np.arange(len(at)), near]
        return pa.StructArray.from_arrays([pa.array(pivot), pa.array(dist)], names=["pivot", "dist"])

    return rows.withColumn("k", assign("v", "band")).select("vec_id", "v", "band", "k.pivot", "k.dist")


def pack(keyed: DataFrame, how: Index, dims: int) -> DataFrame:
    """Consecutive rows of a pivot in order of distance, ``how.segment`` at most in one binary row."""
    kind = pa.schema([("pivot", pa.int32()), ("band", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        held: list[tuple] = []
        count, last = 0, None

        def cut() -> pa.RecordBatch:
            nonlocal held, count
            ids, dist, v = (np.concatenate(x) for x in zip(*held, strict=True))
            row = {"pivot": last[0], "band": last[1], "lo": float(dist[0]), "hi": float(dist[-1]), "ids": ids.astype("<i8").tobytes(), "vectors": v.astype("<f8").tobytes()}
            held, count = [], 0
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for b in batches:
            pivot, band = b.column("pivot").to_numpy(), b.column("band").to_numpy()
            ids, dist, v = b.column("vec_id").to_numpy(), b.column("dist").to_numpy(), _matrix(b.column("v"), dims)
            at = 0
            while at < len(ids):
                if held and pivot[at] != last[0]:
                    yield cut()
                last = int(pivot[at]), int(band[at])
                same = int(np.searchsorted(pivot[at:], last[0], side="right"))
                take = min(same, how.segment - count)
                held.append((ids[at : at + take], dist[at : at + take], v[at : at + take]))
                count, at = count + take, at + take
                if count == how.segment:
                    yield cut()
        if held:
            yield cut()

    ordered = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    return materialize(ordered.mapInArrow(run, "pivot int, band int, lo double, hi double, ids binary, vectors binary"), "annuli")


def slabs(queries: DataFrame, dims: int, how: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, slab by slab; the driver holds one at a time."""
    kind = pa.schema([("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"ids": b.column("vec_id").to_numpy().astype("<i8").tobytes(), "vectors": _matrix(b.column("v"), dims).astype("<f8").tobytes()}], schema=kind)

    ids, vectors, n = [], [], 0
    most = max(1, how.slab // (8 * dims))
    for r in queries.select("vec_id", "v").mapInArrow(run, "ids binary, vectors binary").toLocalIterator():
        own, v = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(-1, dims)
        while len(own):
            take = most - n
            ids.append(own[:take])
            vectors.append(v[:take])
            n, own, v = n + len(own[:take]), own[take:], v[take:]
            if n == most:
                yield np.concatenate(ids), np.concatenate(vectors)
                ids, vectors, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(vectors)


def first_bounds(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A k-th score that the sample already guarantees to each query; the least integer for none."""
    out = np.full(len(ids), -_LONG - 1, np.int64)
    for i in range(0, len(ids), 4096):
        s = scores(q[i : i + 4096], sample)
        s[ids[i : i + 4096, None] == sample_ids] = -_LONG - 1
        if s.shape[1] >= k:
            out[i : i + 4096] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return out


@dataclass(frozen=True)
class Slab:
    """Queries with what is known of them; a column of ``d`` and ``r`` for each pivot."""

    ids: np.ndarray
    raw: np.ndarray  # components before scaling
    kth: np.ndarray
    d: np.ndarray
    done: np.ndarray  # radius searched before
    now: np.ndarray  # radius to search

    def meets(self, radius: np.ndarray, pivot: int, lo: float, hi: float) -> np.ndarray:
        d, r = self.d[:, pivot], radius[:, pivot]
        return (r >= 0) & ~((d + r < lo) | (d - r > hi))  # what isn't a number meets


def radii(q: np.ndarray, kth: np.ndarray, known: Bands) -> np.ndarray:
    """For each query and pivot, the distance beyond which nothing reaches the k-th
    score; -1 where the whole band is too short. Margins cover rounding."""
    out = np.full((len(q), len(known.pivots)), -1.0)
    with np.errstate(over="ignore", invalid="ignore"):
        square = (q * q).sum(axis=1)
        goal = kth.astype(float)
        for band, (i, j) in known.begin.items():
            most = known.most[band]
            near = np.sqrt(np.maximum(square + most - 2 * goal, 0.0))
            near = near + 1e-7 * (np.sqrt(square) + np.sqrt(most)) + 1e-6
            out_of_reach = np.sqrt(square) * np.sqrt(most) * (1 + 1e-9) + 1e-6 < goal * (1 - 1e-9 * np.sign(goal))
            out[:, i:j] = np.where(out_of_reach, -1.0, np.where(np.isnan(near), np.inf, near))[:, None]
    return out


def scan(index: DataFrame, shared, known, k: int, counted=None) -> DataFrame:
    """``query_id, vec_id, score``: in each partition the k best of each query of the
    slab, at its known k-th score or above, among the annuli of this step."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        slab, bands = shared.value, known.value
        q, kth = integers(slab.raw, bands.scale), slab.kth.copy()
        rows: list[list[np.ndarray]] = [[], [], []]
        held = 0

        def compact():
            nonlocal rows, held
            if not held:
                return
            i, ids, s = (np.concatenate(x) for x in rows)
            order = np.lexsort((ids, -1 - s, i))  # -1 - s: descending, also for the least integer
            i, ids, s = i[order], ids[order], s[order]
            first = np.searchsorted(i, i)
            place = np.arange(len(i)) - first
            full = place == k - 1
            kth[i[full]] = np.maximum(kth[i[full]], s[full])
            keep = place < k
            rows, held = [[i[keep]], [ids[keep]], [s[keep]]], int(keep.sum())

        for b in batches:
            for pivot, lo, hi, raw_ids, raw in zip(*(b.column(c).to_pylist() for c in ("pivot", "lo", "hi", "ids", "vectors")), strict=True):
                use = np.flatnonzero(slab.meets(slab.now, pivot, lo, hi) & ~slab.meets(slab.done, pivot, lo, hi))
                if not len(use):
                    continue
                ids, x = np.frombuffer(raw_ids, "<i8"), integers(np.frombuffer(raw, "<f8").reshape(-1, bands.dims), bands.scale)
                if counted is not None:
                    counted.add(len(use) * len(ids))
                for part in np.array_split(use, -(-len(use) * len(ids) // 4_000_000)):
                    s = scores(q[part], x)
                    at, col = np.nonzero((s >= kth[part, None]) & (ids != slab.ids[part, None]))
                    for own, new in zip(rows, (part[at], ids[col], s[at, col]), strict=True):
                        own.append(new)
                    held += len(at)
                    if held > 500_000 + k * len(q):
                        compact()
        compact()
        if held:
            i, ids, s = (np.concatenate(x) for x in rows)
            yield pa.RecordBatch.from_arrays([pa.array(slab.ids[i]), pa.array(ids), pa.array(s)], schema=kind)

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def wanted(slab: Slab) -> Column | None:
    """Condition on the index's keys: annuli that some query of the slab still needs."""
    parts = []
    for p in range(slab.d.shape[1]):
        use = (slab.now[:, p] >= 0) & ((slab.now[:, p] > slab.done[:, p]) | np.isnan(slab.d[:, p]))
        if use.any():
            near, far = (slab.d[use, p] - slab.now[use, p]).min(), (slab.d[use, p] + slab.now[use, p]).max()
            own = F.col("pivot") == p
            parts.append(own & (F.col("hi") >= float(near)) & (F.col("lo") <= float(far)) if np.isfinite([near, far]).all() else own)
    return reduce(lambda a, b: a | b, parts) if parts else None


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, how: Index = Index(), column: str = "embedding", id_column: str = "vec_id", scale: int = 64, counted=None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row that ``queries`` (a condition on
    ``vec_id``) chooses, against every other row. ``counted``, an accumulator, gets the
    number of scores computed."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    rows = measure(rows, scale).where(F.col("band").isNotNull())
    found = rows.groupBy("band").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max("log").alias("log")).orderBy("band").collect()  # a few thousand bands at most
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not found:
        return nothing
    total, dims = sum(r["n"] for r in found), max(1, *(r["dims"] for r in found), 0)
    with np.errstate(over="ignore"):
        # floor() moves each component by less than one.
        most = {r["band"]: float((np.exp2(np.float64(r["log"])) + np.sqrt(dims)) ** 2 * (1 + 1e-9)) for r in found}
    turn = F.xxhash64("vec_id")
    rate = int(min(1.0, how.sample / total) * 1_000_003)
    some = rows.where(F.pmod(turn, F.lit(1_000_003)) <= rate).orderBy(turn, "vec_id").limit(how.sample).toArrow()
    sample_raw = _matrix(some.column("v").combine_chunks(), dims) if some.num_rows else np.zeros((0, dims))
    with np.errstate(over="ignore"):
        points = np.floor(scale * sample_raw)
    bands = pick_pivots(most, points, some.column("band").to_numpy(), how, dims, scale)
    known = spark.sparkContext.broadcast(bands)
    index = pack(key(rows, known), how, dims)
    sample_ids, sample = some.column("vec_id").to_numpy()[:1024], integers(sample_raw[:1024], scale)

    folder, written = new_path(spark, "found"), False
    for number, (ids, raw) in enumerate(slabs(rows.where(queries), dims, how)):
        q = integers(raw, scale)
        kth = first_bounds(ids, q, sample_ids, sample, k)
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(scale * raw)
            d = distances(np.column_stack([flat, np.zeros(len(flat))]), bands.pivots)
        done = np.full(d.shape, -1.0)
        for step in how.steps:
            full = radii(flat, kth, bands)
            now = np.where(full < 0, -1.0, np.maximum(full * step, done))
            slab = Slab(ids, raw, kth, d, done, now)
            which = wanted(slab)
            if which is None:
                continue
            shared = spark.sparkContext.broadcast(slab)
            scan(index.where(which), shared, known, k, counted).write.parquet(f"{folder}/slab={number}/step={step}")
            written = True
            shared.destroy()
            if step < 1:  # the bounds so far: a row for each query of the slab at most
                so_far = spark.read.schema("query_id long, vec_id long, score long").option("basePath", folder).parquet(f"{folder}/slab={number}")
                at = top(so_far, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
                better = dict(zip(at.column("query_id").to_pylist(), at.column("score").to_pylist(), strict=True))
                kth = np.maximum(kth, np.array([better.get(i, -_LONG - 1) for i in ids.tolist()], np.int64))
                done = np.maximum(done, now)
    if not written:
        return nothing
    return top(spark.read.schema("query_id long, vec_id long, score long").parquet(f"{folder}/*/*"), k).select("query_id", "rank", "vec_id", "score")

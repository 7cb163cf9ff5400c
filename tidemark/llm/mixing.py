"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows are dealt to disjoint blocks by a keyed hash. A target gives
every source whole passes and one partial pass: blocks of a permutation as long as
they fit, and the first that doesn't, cut at the row whose middle is nearest the rest. A
binary tree splits these exact block quotas among output shards: at each node
the left half receives a multivariate-hypergeometric draw from the node's pool,
so every shard's make-up is that of a random deal, and leaves take consecutive,
hence disjoint, blocks. Within a shard rows are ordered by a keyed hash.

The driver sees one row per source and one per source and block (``BLOCK_TABLE``
together, or one a source where there are more sources), never rows of the corpus;
selection is an expression against a table of one row per source, which is broadcast
up to ``BROADCAST_SOURCES`` of them and else joined in parts, so that a source of a
third of all rows isn't one task. Reruns with the same seed agree.

Edge cases: a null text has no words, a very long one is counted whole; a null source
is a source, the last one; rows without words are taken as often as their block;
identical rows are taken alike, and rows of equal key and text go the same way (ties);
an empty table gives an empty result; extra columns are kept as they are, whatever
their names.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, WORD, literal_rows, materialize, new_path, salt

#: Sources whose plan is broadcast, and rows of the plan in one literal.
BROADCAST_SOURCES, LITERAL = 5_000, 5_000
#: Rows of the table of blocks that the driver reads, and blocks of a source.
BLOCK_TABLE, BLOCKS = 400_000, 1024


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    shards: int = 16
    seed: int = 20240607


@dataclass(frozen=True)
class Plan:
    """One row per source, the blocks of a source, and whether the table may be broadcast."""

    table: DataFrame
    blocks: int
    small: bool


def targets(sizes: list[int], how: Mix) -> list[float]:
    """Words wanted of each source, in source order: weights repeat, no target
    above ``most`` times its size, what is above is shared anew by weight."""
    weight = [how.weights[i % len(how.weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), how.share * sum(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = {i for i in open_ if unit * weight[i] > how.most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = how.most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def split_quotas(quotas: list[int], shards: int, rng: random.Random) -> list[list[int]]:
    """Quotas of each shard: rows sum to a fair number of blocks, columns to the quotas."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    n = round(sum(quotas) * left / shards)
    mine = [0] * len(quotas)
    for i in rng.sample(range(len(quotas)), n, counts=quotas) if n else ():
        mine[i] += 1
    return split_quotas(mine, left, rng) + split_quotas([q - m for q, m in zip(quotas, mine, strict=True)], shards - left, rng)


def plan_blocks(words: list[list[int]], want: list[float], how: Mix) -> list[dict]:
    """For each source: the shard of every block in each pass (-1: not drawn), the
    block that is cut and the words to take of it."""
    rng = random.Random(how.seed)
    draws: list[list[tuple[int, int]]] = []
    out = []
    for block_words, target in zip(words, want, strict=True):
        size, n = sum(block_words), len(block_words)
        whole = min(int(target / size + 1e-12), 2) if size else 1
        rest = max(0.0, target - whole * size)
        mine, cut, cut_words = [], -1, 0.0
        for p in range(whole):
            order = list(range(n))
            rng.shuffle(order)
            mine += [(p, b) for b in order]
        order = list(range(n))
        rng.shuffle(order)
        for b in order if whole < 2 and rest > 0.5 else ():
            if block_words[b] <= rest:
                mine.append((whole, b))
                rest -= block_words[b]
            elif cut < 0:  # the first that doesn't fit is cut, by what later ones leave
                cut = b
        if cut >= 0:
            cut_words = rest
            mine.append((whole, cut))
        draws.append(mine)
        out.append({"pass_0": [-1] * n, "pass_1": [-1] * n, "cut_pass": whole, "cut_block": cut, "cut_words": cut_words})
    taken = [0] * len(draws)
    for s, quota in enumerate(split_quotas([len(d) for d in draws], how.shards, rng)):
        for i, q in enumerate(quota):
            for p, b in draws[i][taken[i] : taken[i] + q]:
                out[i][f"pass_{p}"][b] = s
            taken[i] += q
    return out


def _row_key(key: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.coalesce(F.col(text), F.lit(""))))


def _passes(prefix: str = "") -> Column:
    """Shards that take the row, one entry for each time; -1 for none."""

    def one(p: int) -> Column:
        drawn = F.element_at(f"{prefix}pass_{p}", F.col(f"{prefix}block") + 1)
        cut = (F.col(f"{prefix}cut_pass") == p) & (F.col(f"{prefix}cut_block") == F.col(f"{prefix}block"))
        return F.when(cut & ~F.coalesce(F.col(f"{prefix}row") <= F.col(f"{prefix}cut_row"), F.lit(False)), F.lit(-1)).otherwise(drawn)

    return F.filter(F.array(one(0), one(1)), lambda s: s >= 0)


def prepare(df: DataFrame, how: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, Plan]:
    """The rows without their texts, and the plan."""
    spark = df.sparkSession
    slim = materialize(
        df.select(
            F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _row_key(key, text, how.seed).alias("row")
        ),
        "mix-rows",
    )
    found = slim.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row for each source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    blocks = max(1, min(BLOCKS, BLOCK_TABLE // max(1, len(found))))
    at = {r["source"]: i for i, r in enumerate(found)}
    words = [[0] * blocks for _ in found]
    blocked = slim.withColumn("block", F.pmod(F.col("row"), F.lit(blocks)).cast("int"))
    for r in blocked.groupBy("source", "block").agg(F.sum("size").alias("size")).toLocalIterator():
        words[at[r["source"]]][r["block"]] = r["size"]
    want = targets([r["size"] for r in found], how)
    plan = [{"source": r["source"], "source_size": r["size"], "target": t} | p for r, t, p in zip(found, want, plan_blocks(words, want, how), strict=True)]
    small = [{k: p[k] for k in ("source", "cut_block", "cut_words")} for p in plan if p["cut_block"] >= 0]
    cut = _table(spark, small, "source string, cut_block int, cut_words double")
    # Only rows of the one cut block of each source are ordered.
    in_cut = _of_source(blocked, cut, "source", "row", len(found) <= BROADCAST_SOURCES).where("block = cut_block")
    order = Window.partitionBy("source").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("words").over(order) - F.col("words") / 2
    cut_rows = in_cut.groupBy("source", "row", "cut_words").agg(F.sum("size").alias("words")).withColumn("middle", middle).where("middle <= cut_words").groupBy("source").agg(F.max("row").alias("row")).collect()  # one per source
    last = {r["source"]: r["row"] for r in cut_rows}
    plan = [p | {"cut_row": last.get(p["source"])} for p in plan]
    table = _table(spark, plan, "source string, source_size long, target double, pass_0 array<int>, pass_1 array<int>, cut_pass int, cut_block int, cut_words double, cut_row long")
    return slim, Plan(table, blocks, len(found) <= BROADCAST_SOURCES)


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Driver-side rows as a table; many of them are written in pieces."""
    if len(rows) <= BROADCAST_SOURCES:
        return literal_rows(spark, rows, schema)
    path = new_path(spark, "mix-plan")
    for i in range(0, len(rows), LITERAL):
        literal_rows(spark, rows[i : i + LITERAL], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _of_source(rows: DataFrame, plan: DataFrame, source: str, by: str, small: bool, mark: str = "") -> DataFrame:
    """Joins rows with their source's row of the plan, whose columns get the prefix ``mark``;
    a plan that isn't small meets the rows of a source in ``SALTS`` parts."""
    own = [c for c in plan.columns if c != "source"]
    right = plan.select(F.col("source").alias("__of"), *[F.col(c).alias(mark + c) for c in own])
    same = F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__of"))
    if small:
        return rows.join(F.broadcast(right), same).drop("__of")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt(by)).join(right, same & (F.col("__salt") == F.col("__part"))).drop("__of", "__salt", "__part")


def shares(df: DataFrame, how: Mix = Mix()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, shards, orders`` of every row;
    ``shards`` has the output shard of each copy and ``orders`` its place there."""
    slim, plan = prepare(df, how)
    rows = slim.withColumn("block", F.pmod(F.col("row"), F.lit(plan.blocks)).cast("int"))
    rows = _of_source(rows, plan.table, "source", "row", plan.small)
    rows = rows.withColumn("shards", _passes())
    copies = F.size("shards")
    orders = F.transform("shards", lambda s, p: _place(how, s, p, F.col("row")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "shards", orders.alias("orders"))


def _place(how: Mix, shard: Column, turn: Column, row: Column) -> Column:
    return F.xxhash64(F.lit(how.seed + 1), shard, turn, row)


def mix(df: DataFrame, how: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source", *, keep_place: bool = False) -> DataFrame:
    """The mix itself: every row as often as it is drawn, gathered by output shard and in
    the shard's shuffled order.

    Partitions hold parts of shards, ``parts`` of each by the order's remainder, sorted.
    With ``keep_place`` two columns follow: ``mix_shard`` and ``mix_order``.
    """
    spark = df.sparkSession
    _, plan = prepare(df, how, key, text, source)
    mark = "__mix_"
    drawn = df.withColumn(f"{mark}row", _row_key(key, text, how.seed)).withColumn(f"{mark}block", F.pmod(F.col(f"{mark}row"), F.lit(plan.blocks)).cast("int"))
    drawn = _of_source(drawn, plan.table, source, f"{mark}row", plan.small, mark)
    drawn = drawn.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{mark}row"), F.posexplode(_passes(mark)).alias(f"{mark}pass", f"{mark}shard"))
    drawn = drawn.withColumn(f"{mark}order", _place(how, F.col(f"{mark}shard"), F.col(f"{mark}pass"), F.col(f"{mark}row")))
    parts = -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // how.shards)
    drawn = drawn.repartition(F.col(f"{mark}shard"), F.pmod(F.col(f"{mark}order"), F.lit(parts))).sortWithinPartitions(f"{mark}shard", f"{mark}order")
    own = [F.col(f"`{c}`") for c in df.columns]
    return drawn.select(*own, F.col(f"{mark}shard").alias("mix_shard"), F.col(f"{mark}order").alias("mix_order")) if keep_place else drawn.select(*own)


def write(mixed: DataFrame, path: str) -> None:
    """Files of each shard in a folder of its own, from :func:`mix` with ``keep_place``."""
    mixed.write.partitionBy("mix_shard").parquet(path)

"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Law ``bytes``: shard sizes are near equal and equal texts stay together where
they fit. A text's hash is its place on the ring; each shard owns the arcs that
end at its virtual nodes and holds at most ``(1 + slack)`` times the mean bytes;
what overflows a full shard continues clockwise to the next one with room. The
ring is resolved to ``cells`` equal arcs, so the driver only ever sees the load
of each cell and the (at most ``cells + shards``) intervals they are cut into.

Everything that touches rows is DataFrame code: a unit is one distinct text, or
for a text with very many copies a salted part of its rows, and it is placed
whole, by where its middle falls among the bytes of its cell. A shard therefore
misses its share by at most half a unit for each of its cuts.

Edge cases: a null text weighs as an empty one (8 bytes) and shares its place;
null ids are ids like any other; identical rows (same id, same text) stay in one
unit; a very long text is a unit like any other; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, materialize

CELL_BITS = 12
#: A text whose rows hold more than this share of a shard is dealt in salted parts.
WHOLE_SHARE = 0.0025
#: Buckets in which slots are counted, for each shard.
SLOT_BUCKETS = 1024


def ring_owners(shards: int, vnodes: int, bits: int = CELL_BITS) -> list[list[int]]:
    """For each cell, the shards met clockwise from it, each once."""
    cells = 1 << bits
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) >> (64 - bits), s, v) for s in range(shards) for v in range(vnodes))
    at = [[] for _ in range(cells)]
    for cell, s, _ in points:
        at[cell].append(s)
    # Walk backwards: the order seen from a cell is its own points, then the next cell's order.
    seen: list[int] = []
    out: list[list[int]] = [[]] * cells
    for _ in range(2):
        for cell in range(cells - 1, -1, -1):
            if at[cell]:
                head = list(dict.fromkeys(at[cell]))
                seen = head + [s for s in seen if s not in head]
            out[cell] = seen
    return out


def cut_cells(loads: dict[int, int], shards: int, vnodes: int, slack: float, bits: int = CELL_BITS) -> list[dict]:
    """Intervals of each cell's bytes and the shard that takes them."""
    total = sum(loads.values())
    room = [total * (1 + slack) / shards] * shards
    owners, out = ring_owners(shards, vnodes, bits), []
    for cell in sorted(loads):
        left, at = loads[cell], 0.0
        for s in owners[cell]:
            if left <= 0:
                break
            if room[s] <= 0:
                continue
            take = min(left, room[s])
            out.append({"cell": cell, "from_b": at, "to_b": at + take, "shard": s})
            room[s] -= take
            at += take
            left -= take
        if out and out[-1]["cell"] == cell:
            out[-1]["to_b"] = 1e300  # rounding leaves nothing outside
    return out


def shard(df: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", *, vnodes: int = 64, slack: float = 0.001) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the UTF-8 bytes of the text plus 8; ``slot`` counts each shard's
    rows from 0 without gaps; ``grown_shard`` is null, as it belongs to another law.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.xxhash64(body)
    slim = materialize(
        df.select(
            F.col(key).cast("long").alias("doc_id"),
            (F.octet_length(body).cast("long") + 8).alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            place.alias("place"),
            F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int").alias("cell"),
        ),
        "ring-rows",
    )
    loads = {r["cell"]: r["b"] for r in slim.groupBy("cell").agg(F.sum("size").alias("b")).collect()}  # at most 2**CELL_BITS rows
    share = sum(loads.values()) / shards
    part = max(share * WHOLE_SHARE, 1.0)
    # At most shards / WHOLE_SHARE texts can be as large as this.
    large = slim.groupBy("place").agg(F.sum("size").alias("b")).where(F.col("b") > part).select("place", (F.ceil(F.col("b") / part) * 4).alias("parts"))
    keyed = slim.join(F.broadcast(large), "place", "left").select(
        "doc_id", "size", "text_crc32", "cell", "place", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("part")
    )
    in_cell = Window.partitionBy("cell").orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    units = keyed.groupBy("cell", "place", "part").agg(F.sum("size").alias("b")).select("cell", "place", "part", (F.coalesce(F.sum("b").over(in_cell), F.lit(0)) + F.col("b") / 2).alias("middle"))
    cuts = literal_rows(spark, cut_cells(loads, shards, vnodes, slack), "cell int, from_b double, to_b double, shard int")
    placed = units.join(F.broadcast(cuts), "cell").where((F.col("middle") >= F.col("from_b")) & (F.col("middle") < F.col("to_b"))).select("cell", "place", "part", "shard")
    rows = keyed.join(placed, ["cell", "place", "part"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"))
    rows = materialize(rows, "ring-placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # at most shards * SLOT_BUCKETS rows
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside).cast("long")).join(F.broadcast(counts), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("base") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""What the corpus operators share: the shared work folder and small helpers.

Word separators are the six ASCII blanks (space and U+0009 to U+000D), so a
word is a run of anything else.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; none for null. Bytes are split at just these blanks."""
    return text.encode().split() if text else []


def words_of(text: str | None) -> list[str]:
    """Words of a text; none for null."""
    if not text:
        return []
    if text.isascii() and not any(c in text for c in _ODD):  # what str.split() takes for blanks too
        return text.split()
    return [w.decode() for w in text.encode().split()]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests, a laptop) a
    temporary folder is set; a cluster without a shared folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if base:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
        return base.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corpus-work-')}")
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage.

    A lost executor costs a reread, not a recomputation. The files belong to
    the job and go with its work folder.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way to a result, which go once it is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return materialize(df, name, self.paths[-1])

    def clear(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in self.paths:
            place = hadoop(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


@contextmanager
def arrow_batches(spark: SparkSession, most: int):
    """Within it, batches sent to Python workers have about ``most`` bytes at the most."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


#: Parts in which the rows of a hot key are dealt.
SALTS = 64


def salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts_held() -> Column:
    """Aggregate of the column ``salt``: which parts a key has, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt")))


def each_salt(bits: str) -> Column:
    """A row for each of these parts."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("shiftrightunsigned", F.col(bits), i).bitwiseAND(F.lit(1)) == 1))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from driver-side rows, without Python in the plan."""
    text = json.dumps(rows)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


class Cache(dict):
    """What ``make`` gives for each key; starts anew when it has ``most`` entries.

    Keys longer than ``longest`` are made each time.
    """

    def __init__(self, make, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_CLEAR: dict[str, list] = {}
_USER: list[str] = []


def owns(user: str, *clear) -> None:
    """Registers what empties an operator's caches in this process."""
    _CLEAR.setdefault(user, []).extend(clear)


def claim(user: str) -> None:
    """Empties other operators' caches when a reused worker turns to this one."""
    if _USER != [user]:
        for other, clear in _CLEAR.items():
            if other != user:
                for f in clear:
                    f()
        _USER[:] = [user]

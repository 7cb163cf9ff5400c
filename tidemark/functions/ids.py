"""Forecaster identities: label columns joined into one readable id, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = " + "


def unique_id(columns: list[str]) -> Column:
    """Labels joined by ' + '; a null label leaves an empty place."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def readable(uid: str | Column) -> Column:
    """Without the separators that empty labels leave at the end."""
    return F.trim(F.regexp_replace(F.col(uid) if isinstance(uid, str) else uid, r"(\s*\+\s*)+$", ""))


def split_id(df: DataFrame, columns: list[str], uid: str = "unique_id") -> DataFrame:
    """Label columns from the id; existing ones are replaced."""
    parts = F.split(F.col(uid), r" \+ ")
    return df.withColumns({c: F.get(parts, i) for i, c in enumerate(columns)})


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def parts(uid: str | Column = "unique_id") -> Column:
    return F.transform(F.split(F.col(uid) if isinstance(uid, str) else uid, r"\+"), lambda x: F.trim(x))


def excluded_parts(uids: list[str], wanted: list[str]) -> set[str]:
    """Labels to leave out so that only ``wanted`` ones remain wherever they occur.

    At each position where a wanted label occurs, the other labels of that position
    are excluded; where none occurs anywhere, everything is.
    """
    split = [[p.strip() for p in u.split("+")] for u in uids]
    out: set[str] = set()
    hit = False
    for i in range(max(map(len, split), default=0)):
        here = {s[i] for s in split if i < len(s)}
        if here & set(wanted):
            hit = True
            out |= here - set(wanted)
    return out if hit else {p for s in split for p in s}

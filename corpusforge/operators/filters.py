"""Row predicates of a search, and the request that they come from."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilter:
    """A period, closed at both ends, either of which may be open; and types, matched exactly."""

    start: datetime | None = None
    end: datetime | None = None
    types: tuple[str, ...] = ()

    @staticmethod
    def from_request(start: str | None = None, end: str | None = None, types: list[str] | None = None) -> SearchFilter | None:
        """Dates that aren't ISO are ignored; None if nothing is left."""

        def parse(x: str | None) -> datetime | None:
            try:
                return datetime.fromisoformat(x) if x else None
            except ValueError:
                return None

        made = SearchFilter(parse(start), parse(end), tuple(types or ()))
        return made if made.start or made.end or made.types else None

    def column(self, date: str = "create_date", kind: str = "type") -> Column:
        """A row without a date is out whenever a period is given, one without a type whenever types are."""
        out = F.lit(True)
        if self.start or self.end:
            out = out & F.col(date).isNotNull()
        if self.start:
            out = out & (F.col(date) >= F.lit(self.start))
        if self.end:
            out = out & (F.col(date) <= F.lit(self.end))
        if self.types:
            out = out & F.coalesce(F.col(kind).isin(*self.types), F.lit(False))
        return out


def apply(df: DataFrame, f: SearchFilter | None) -> DataFrame:
    return df if f is None else df.where(f.column())


def at_least_one(n: int) -> int:
    return max(n, 1)


def drop_seen(found: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    return found.join(seen.select(*keys), list(keys), "left_anti")


def existing(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return ids.join(known.select(key), key, "left_semi")


def judged_relevant(chunks: DataFrame, indices: str = "indices", pos: str = "pos", size: str = "size") -> DataFrame:
    """Chunks whose position the judge names; one position out of range voids the whole reply."""
    valid = F.forall(indices, lambda i: (i >= 0) & (i < F.col(size)))
    return chunks.where(valid & F.array_contains(indices, F.col(pos)))


def by_date(df: DataFrame, rank: str = "rank") -> list[Column]:
    """The earliest first, without a date last, then as they stood."""
    return [F.col("create_date").asc_nulls_last(), F.col(rank).asc()]


def places_by_date(df: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """Adds place (from 1): the order by date within each group. No task sees all rows of a group: they are numbered within their
    date, after the rows of the dates before, of which there is one count each."""
    sizes = df.groupBy(group, "create_date").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy(F.col("create_date").asc_nulls_last())) - F.col("_n")
    sizes = sizes.select(F.col(group).alias("_group"), F.col("create_date").alias("_date"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "create_date").orderBy(rank))
    rows = df.withColumn("_own", own).join(sizes, F.col(group).eqNullSafe(F.col("_group")) & F.col("create_date").eqNullSafe(F.col("_date")))
    return rows.withColumn("place", F.col("_before") + F.col("_own")).drop("_own", "_group", "_date", "_before")

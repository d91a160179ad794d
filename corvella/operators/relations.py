"""Links between collections, kept as rows (source, source_id, link, target, target_id) of a relations table.

One join serves all asked sources at once. Relation rows of deleted documents stay and are hidden by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.errors import QueryError

RELATIONS = "source string, source_id long, link string, target string, target_id long"


def load_links(relations: DataFrame, source: str, link: str, target: DataFrame, target_id: str, sources: DataFrame | None = None) -> DataFrame:
    """(source_id, target fields): the targets that exist, of all sources or of a ``sources`` frame (source_id)."""
    rows = relations.where((F.col("source") == source) & (F.col("link") == link)).select("source_id", "target_id")
    rows = rows.join(sources, "source_id", "left_semi") if sources is not None else rows
    return rows.join(target, F.col("target_id") == F.col(target_id)).drop("target_id")


def load_one(relations: DataFrame, source: str, link: str, target: DataFrame, target_id: str, sources: DataFrame | None = None) -> DataFrame:
    """To-one: the target with the smallest id that exists, for each source."""
    rows = load_links(relations, source, link, target, target_id, sources)
    whole = F.struct(F.col(target_id).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("row"))
    return rows.groupBy("source_id").agg(F.min_by(whole, target_id).alias("x")).select("source_id", "x.row.*")


def load_backlinks(relations: DataFrame, source: str, link: str, origin: DataFrame, origin_id: str, targets: DataFrame | None = None) -> DataFrame:
    """(target_id, origin fields): the documents of ``source`` whose link leads to each target."""
    rows = relations.where((F.col("source") == source) & (F.col("link") == link)).select("source_id", "target_id")
    rows = rows.join(targets, "target_id", "left_semi") if targets is not None else rows
    return rows.join(origin, F.col("source_id") == F.col(origin_id)).drop("source_id")


def check_ends(source: str, link: str, source_frame: DataFrame, source_id: str, sources: list[int], target_frame: DataFrame, target_id: str, targets: list[int]) -> None:
    """Raises unless all documents that a link is to join exist."""
    for frame, key, ids in ((source_frame, source_id, sources), (target_frame, target_id, targets)):
        wanted = frame.sparkSession.createDataFrame([(int(i),) for i in ids], f"{key} long")
        if lost := wanted.join(frame, key, "left_anti").limit(1).collect():
            raise QueryError(f"{source}.{link}: no document with id {lost[0][0]}")


def replace_links(relations: DataFrame, source: str, link: str, target: str, wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """Relations where each of ``sources`` (source_id) links to exactly its ``wanted`` (source_id, target_id) rows."""
    mine = (F.col("source") == source) & (F.col("link") == link)
    kept = relations.where(~mine).unionByName(relations.where(mine).join(sources.select("source_id").distinct(), "source_id", "left_anti"))
    new = wanted.select("source_id", "target_id").distinct().select(F.lit(source).alias("source"), "source_id", F.lit(link).alias("link"), F.lit(target).alias("target"), "target_id")
    return kept.unionByName(new)


class LinkSet:
    """The client's side of a to-many link: changed in memory, then saved as a whole."""

    def __init__(self, ids=()):
        self.ids = [*ids]

    def add(self, id: int) -> None:
        if id in self.ids:
            raise ValueError(f"{id} is linked already")
        self.ids.append(id)

    def remove(self, id: int) -> None:
        self.ids.remove(id)

    def reset(self) -> None:
        self.ids.clear()

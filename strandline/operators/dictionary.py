"""String dictionaries (id, name), string arrays and tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import dense_ids


def string_array(rows: DataFrame, text: Callable[[], Column] | None = None, choose: Column | None = None, order: str = "id") -> DataFrame:
    """(id, string) from ordered rows, with a transformation and a filter; ids are dense."""
    kept = rows if choose is None else rows.filter(choose)
    ids = dense_ids(kept, [order], "new_id")
    return kept.join(ids, order).select(F.col("new_id").alias("id"), (text() if text else F.col("string")).alias("string"))


def from_map(tags: Column) -> Column:
    """Keys and values in turn, by key."""
    return F.flatten(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.array(e["key"], e["value"])))


def duplicated(strings: DataFrame, transform: Callable[[Column], Column]) -> DataFrame:
    """Each string i as 2i, and its transformation as 2i + 1."""
    pair = F.array(F.struct((F.col("id") * 2).alias("id"), F.col("string").alias("string")), F.struct((F.col("id") * 2 + 1).alias("id"), transform(F.col("string")).alias("string")))
    return strings.select(F.inline(pair))


def even_only(strings: DataFrame) -> DataFrame:
    """The inverse of ``duplicated``."""
    return strings.filter("id % 2 = 0").select(F.shiftright("id", 1).alias("id"), "string")


def remove_id(strings: DataFrame, gone: int) -> DataFrame:
    """Drop one id and close the gap."""
    return strings.filter(F.col("id") != gone).withColumn("id", F.when(F.col("id") > gone, F.col("id") - 1).otherwise(F.col("id")))


def find_strings(dictionary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(string, id): the id of each string; the dictionary's size if it is not there."""
    size = dictionary.agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(dictionary, "string", "left").crossJoin(F.broadcast(size)).select("string", F.coalesce("id", "n").alias("id"))  # one row


def strings_of(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, string): the empty string for an unknown id."""
    return ids.join(dictionary, "id", "left").select("id", F.coalesce("string", F.lit("")).alias("string"))


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of the first dictionary, then what the second adds, in its order."""
    new = second.join(first.select("string"), "string", "left_anti")
    ranks = dense_ids(new, ["id"], "rank")
    size = first.agg(F.count(F.lit(1)).alias("n"))
    added = new.join(ranks, "id").crossJoin(F.broadcast(size)).select((F.col("n") + F.col("rank")).alias("id"), "string")  # one row
    return first.select("id", "string").unionByName(added)


def sorted_ids(dictionary: DataFrame) -> DataFrame:
    """(rank, id, string) in byte order."""
    ranks = dense_ids(dictionary, ["string", "id"], "rank")
    return ranks.select("rank", "id", "string")


def duplicates(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def alphabet(strings: DataFrame) -> DataFrame:
    """(code, char): the distinct characters, numbered in byte order."""
    chars = strings.select(F.explode(F.split("string", "")).alias("char")).filter("char <> ''").distinct()
    return dense_ids(chars, ["char"], "code").select("code", "char")


def compacted(strings: DataFrame) -> DataFrame:
    """(id, pos, code): the strings over the compact alphabet."""
    each = strings.select("id", F.posexplode(F.split("string", "")).alias("pos", "char")).filter("char <> ''")
    return each.join(F.broadcast(alphabet(strings)), "char").select("id", F.col("pos").cast("long").alias("pos"), "code")  # at most one row a character of Unicode


def from_list(rows: DataFrame, strings_col: str) -> DataFrame:
    """A dictionary from an array column of one row, ids by position."""
    return rows.select(F.posexplode(strings_col).alias("id", "string")).withColumn("id", F.col("id").cast("long"))


def running_lengths(strings: DataFrame) -> DataFrame:
    """(id, length, start): where each string begins in the concatenation, by blocks of ids so that no window is global."""
    sized = strings.select("id", F.length("string").cast("long").alias("length"), F.shiftright("id", 16).alias("block"))
    per_block = sized.groupBy("block").agg(F.sum("length").alias("total"))
    starts = per_block.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for 65,536 strings
    inside = F.coalesce(F.sum("length").over(Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("inside", inside).join(F.broadcast(starts), "block").select("id", "length", (F.col("base") + F.col("inside")).alias("start"))


class Tags:
    """A map of tags; keys are lower-cased."""

    def __init__(self, items: dict[str, str] | None = None):
        self.items: dict[str, str] = {}
        for k, v in (items or {}).items():
            self.set(k, v)

    @classmethod
    def from_pairs(cls, strings: list[str]) -> Tags:
        """From keys and values in turn; an odd number or a repeated key is an error."""
        if len(strings) % 2:
            raise ValueError("a key without a value")
        keys = [k.lower() for k in strings[::2]]
        if len(set(keys)) != len(keys):
            raise ValueError("a key twice")
        return cls(dict(zip(keys, strings[1::2], strict=True)))

    def set(self, key: str, value: str) -> None:
        self.items[key.lower()] = value

    def unset(self, key: str) -> None:
        self.items.pop(key.lower(), None)

    def get(self, key: str) -> str:
        return self.items.get(key.lower(), "")

    def contains(self, key: str) -> bool:
        return key.lower() in self.items

    def clear(self) -> None:
        self.items.clear()

    def __len__(self) -> int:
        return len(self.items)

    def __eq__(self, other) -> bool:
        return isinstance(other, Tags) and self.items == other.items

    def column(self) -> Column:
        """As a map literal."""
        return F.create_map(*[F.lit(x) for pair in sorted(self.items.items()) for x in pair])

"""Season files whose columns drift: one read of many CSV files, each by its own header, and fixtures rebuilt from what players' rows say.

All files are read as cells, with a header found in each by a column that every season has. A row's cells go under the names of its own file's header;
a wanted column is taken under the first of its names that the file has. What doesn't fit is kept: columns that nobody asked for, values that
aren't of their type, cells beyond the header, and how many are missing, in a column of rescued JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, written

#: Cells of a row that are read at most; a file with more columns is an error.
MOST_COLUMNS = 120


def read_seasons(spark: SparkSession, path: str, columns: dict[str, str], anchor: str, names: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, columns..., rescued) of all rows below ``path``.

    ``anchor`` is the name of a column that every header has and no row has as a value. ``names`` lists other names of a column, newest first.
    Whole numbers may be written as decimals. Files without a header are left out, and so are empty rows; of a name that a header has twice the first counts.
    A file's name is its last part, or its folder's where the folder is named season=....
    """
    # only as many cells as the widest line can have, as what is done with cells costs by their number
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    widest = spark.read.option("recursiveFileLookup", True).text(path).agg(F.max(commas + 1)).first()[0] or 1
    cells = [f"_c{i}" for i in range(min(MOST_COLUMNS + 1, widest))]
    raw = spark.read.option("header", False).option("escape", "\"").schema(", ".join(f"{c} string" for c in cells)).option("recursiveFileLookup", True).csv(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.array(*cells).alias("cells"))
    width = F.coalesce(F.array_max(F.transform("cells", lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0))
    rows = rows.withColumn("cells", F.slice("cells", F.lit(1), F.greatest(width, F.lit(1)))).filter(F.exists("cells", lambda x: x.isNotNull()))
    too_wide = F.raise_error(F.concat(F.lit("more columns than are read: "), F.col("file")))
    is_header = F.array_contains(F.transform("cells", lambda x: F.trim(x)), anchor)
    head = rows.filter(is_header).groupBy("file").agg(F.min(F.transform("cells", lambda x: F.coalesce(F.trim(x), F.lit("")))).alias("header"))
    head = head.select("file", F.when(F.size("header") > MOST_COLUMNS, too_wide.cast("array<string>")).otherwise(F.col("header")).alias("header"))
    head = written(head, "headers")
    met = rows.filter(~F.coalesce(is_header, F.lit(False))).join(broadcast_if_small(head), "file")
    # pairs of name and value; a name that comes again, or is empty, isn't one
    named = F.transform("header", lambda n, i: F.struct(n.alias("k"), F.get("cells", i).alias("v"), (F.array_position("header", n) == i + 1).alias("first")))
    met = met.withColumn("__m", F.map_from_entries(F.transform(F.filter(named, lambda e: e["first"] & (e["k"] != "")), lambda e: F.struct(e["k"], e["v"]))))
    taken, bad, known = {}, [], set()
    for c, kind in columns.items():
        also = [c, *(names or {}).get(c, [])]
        known |= set(also)
        value = F.coalesce(*(F.nullif(F.trim(F.element_at("__m", F.lit(n))), F.lit("")) for n in also))
        typed = value.try_cast("double").try_cast(kind) if kind in ("int", "long", "bigint") else value.try_cast(kind)
        taken[c] = typed
        bad.append(F.when(typed.isNull() & value.isNotNull(), F.struct(F.lit(c).alias("key"), value.alias("value"))))
    unknown = F.filter(F.map_entries("__m"), lambda e: ~e["key"].isin(*known) & e["value"].isNotNull())
    extra = F.transform(F.slice("cells", F.size("header") + 1, MOST_COLUMNS + 1), lambda x: x)
    more = F.transform(extra, lambda x, i: F.struct(F.concat(F.lit("+"), (i + 1).cast("string")).alias("key"), x.alias("value")))
    kept = F.concat(F.filter(F.array(*bad), lambda e: e.isNotNull()), unknown, F.filter(more, lambda e: e["value"].isNotNull()))
    rescued = F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(F.array_sort(kept))))
    last = F.regexp_extract("file", r"season=([^/]+)/[^/]*$", 1)
    return met.select(F.when(last != "", last).otherwise(F.regexp_extract("file", "[^/]+$", 0)).alias("file"), *(t.alias(c) for c, t in taken.items()), rescued.alias("rescued"))


def voted(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, columns..., n_rows, agreement): of each column the value that most rows of a key give, ties to the smaller one.

    Nulls don't vote. agreement is the least share that a column's winner has of its column's votes; null without any vote. Votes are counted by value
    before they meet, so a key with very many rows is few counts.
    """
    struct = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
    votes = rows.select(*keys, F.inline(F.array(*map(struct, columns)))).filter("value is not null").groupBy(*keys, "column", "value").agg(F.count("*").alias("n"))
    kinds = dict(rows.dtypes)
    sides = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    typed = [F.when(F.col("column") == c, F.struct(-F.col("n"), F.col("value").cast(kinds[c]).alias("v"))) for c in columns]
    winners = votes.groupBy(*keys).agg(*(F.min(t).alias(c) for c, t in zip(columns, typed, strict=True)), *(F.sum(F.when(F.col("column") == c, F.col("n"))).alias(f"__{c}") for c in columns))
    share = [-F.col(f"{c}.col1") / F.col(f"__{c}") for c in columns]
    found = winners.select(*keys, *(F.col(f"{c}.v").alias(c) for c in columns), (F.least(*share) if len(share) > 1 else share[0]).alias("agreement"))
    return sides.join(found, keys, "left").select(*keys, *columns, "n_rows", "agreement")

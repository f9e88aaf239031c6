"""A multidimensional clustered layout: documents along a z-order curve of four coordinates, cut into files.

A coordinate is a sixteenth: 16 times the share of rows with a smaller value, rounded down. The rows of each cell of the
grid (at most 16^4 = 65,536, whatever the input) are counted, and the prefix sums of these counts along z give each cell a
contiguous interval of positions, hence of files. A query of a row depends on its cell alone, so there are as many
queries as cells. The files that hold a match are the union of the intervals of the neighbouring cells, which come
sorted: two of them share a file only where one ends in the file that the next begins with. The files whose bounds a
query meets come from a join of bounds, alike ones as one with their number: a file of one cell has the bounds of that
cell, and of the others each holds a border between two cells of the order, so there are at most 2 * 65,536 bounds.

Nothing that grows with the input is in one task, on the driver or broadcast. Values are counted, ranged by Spark over
its partitions and summed up in each; the driver sees one sum for each partition, and of the values only the smallest
of each coordinate, 64 at most. Rows are ranged by z and doc_id and numbered in the same way. A value, cell or doc_id that
many rows share is split: ranges go on by a row number, and joins stand on written tables that Spark splits where they are
skewed. All joins are sort-merge joins, those of cells and bounds, whose sizes are bounded, as well: nothing is broadcast.

Defined cases: a null source, lang or doc_id (date) is smaller than any value; a null text has length -1; rows with equal z
and doc_id, repeated ones or without doc_id, follow one another in no set order, and differ in position and file alone; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

DIMENSIONS = ("source", "lang", "length", "date")  # in the order of bounds
INTERLEAVED = ("length", "source", "date", "lang")  # of each round of z, the highest binary digit first
CELLS, FILE_ROWS, REACH, DAYS = 16, 500, 2, 365
_BITS = CELLS.bit_length() - 1
RESULT = "doc_id long, z long, position long, file long, files_touched long, files_matching long, file_bounds string"


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, length, date) of docs(doc_id, text, source, lang)."""
    key = F.col("doc_id").cast("long")
    return docs.select(
        key.alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.octet_length("text").cast("long"), F.lit(-1)).alias("length"), (F.crc32(key.cast("string").cast("binary")) % DAYS).cast("long").alias("date"),
    )


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df dealt by Spark into ranges of an order and written, with the number `part` of a row's range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stash(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))


def _before(sums: list[tuple[int, int]]) -> Column:
    """What all lower parts sum up to, by the column part: one number for each partition."""
    at, total = [0] * (max((p for p, _ in sums), default=-1) + 2), 0
    for p, n in sorted(sums):
        at[p] = total
        total += n
    return F.get(F.array(*(F.lit(x).cast("long") for x in at)), F.col("part"))


def coordinates(rows: DataFrame) -> tuple[int, dict[str, list[tuple[int, object]]]]:
    """The number of rows and, of each dimension, its coordinates in falling order with the smallest value of each; 0 has none."""
    none = lambda kind: F.lit(None).cast(kind)
    keys = [
        F.struct(F.lit(i).alias("dim"), (F.col(c) if i < 2 else none("string")).alias("s"), (none("long") if i < 2 else F.col(c)).alias("v"))
        for i, c in enumerate(DIMENSIONS)
    ]
    counts = rows.select(F.explode(F.array(*keys)).alias("key")).groupBy("key.dim", "key.s", "key.v").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("dim"), F.col("s"), F.col("v")]
    ranged = _ranged(counts, *order)
    sums = [tuple(r) for r in ranged.groupBy("part").agg(F.sum("n")).collect()]
    n = sum(x for _, x in sums) // len(DIMENSIONS)
    if not n:
        return 0, {}
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("n").over(run), F.lit(0)) + _before(sums) - F.col("dim") * F.lit(n).cast("long")  # each dimension has n rows in all
    found = ranged.withColumn("smaller", smaller).withColumn("at", F.expr(f"{CELLS} * smaller div {n}"))
    first = found.groupBy("dim", "at").agg(F.min(F.struct("s", "v")).alias("x")).where("at > 0").orderBy("dim", F.desc("at")).collect()
    return n, {c: [(r["at"], r["x"]["s" if i < 2 else "v"]) for r in first if r["dim"] == i] for i, c in enumerate(DIMENSIONS)}


def located(rows: DataFrame, cuts: dict[str, list[tuple[int, object]]]) -> DataFrame:
    """rows with coordinates instead of values."""

    def at(c: str) -> Column:
        out = None
        for k, least in cuts.get(c, []):
            out = (F if out is None else out).when(F.col(c) >= F.lit(least), k)
        return (F.lit(0) if out is None else out.otherwise(0)).cast("long").alias(c)

    return rows.select("doc_id", *map(at, DIMENSIONS))


def interleaved() -> Column:
    """z of a row's coordinates."""
    bits = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), len(INTERLEAVED) * b + 3 - i) for b in range(_BITS) for i, c in enumerate(INTERLEAVED)]
    z = bits[0]
    for x in bits[1:]:
        z = z.bitwiseOR(x)
    return z.cast("long")


def intervals(rows: DataFrame, file_rows: int) -> DataFrame:
    """(z, coordinates, low, high) of every cell: its first and last file, from the prefix sums of the counts along z.

    Cells are summed up in blocks of 256 neighbours, and the blocks, 256 at most, in a row.
    """
    cells = stash(rows.groupBy("z", *DIMENSIONS).agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.shiftright("z", 8)))
    blocks = cells.groupBy("block").agg(F.sum("n").alias("b"))
    upto = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = blocks.select("block", upto(Window.orderBy("block"), "b").alias("start"))  # 256 rows at most
    placed = cells.join(start.hint("merge"), "block").withColumn("start", F.col("start") + upto(Window.partitionBy("block").orderBy("z"), "n"))
    file = lambda p: F.expr(f"({p}) div {file_rows}")
    return placed.select("z", *DIMENSIONS, file("start").alias("low"), file("start + n - 1").alias("high"))


def matching(cells: DataFrame, reach: int) -> DataFrame:
    """(z, files_matching): of each cell's query, the files in the union of its neighbours' intervals."""
    near = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - reach), F.least(F.lit(CELLS - 1), F.col(c) + reach)))
    asked = cells.select(F.col("z").alias("q"), "source", "lang", near("length").alias("length"), "date").withColumn("date", near("date"))
    there = asked.join(cells.hint("merge"), list(DIMENSIONS)).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs"))
    step = lambda acc, x: F.struct(
        (acc["n"] + x["high"] - x["low"] + F.when(x["low"] == acc["last"], 0).otherwise(1)).alias("n"), x["high"].alias("last")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("last"))
    return there.select(F.col("q").alias("z"), F.aggregate("runs", zero, step, lambda acc: acc["n"]).alias("files_matching"))


def bounds(rows: DataFrame) -> DataFrame:
    """(file, <dimension>_min, <dimension>_max)."""
    return rows.groupBy("file").agg(*(f(c).alias(f"{c}_{name}") for c in DIMENSIONS for name, f in (("min", F.min), ("max", F.max))))


def touched(cells: DataFrame, files: DataFrame, reach: int) -> DataFrame:
    """(z, files_touched): of each cell's query, the files whose bounds it meets."""
    sides = [f"{c}_{x}" for c in DIMENSIONS for x in ("min", "max")]
    alike = files.groupBy(*sides).agg(F.count(F.lit(1)).alias("files"))
    every = lambda c: F.explode(F.sequence(f"{c}_min", f"{c}_max")).alias(c)
    rest = [s for s in sides if not s.startswith("source")]
    keyed = alike.select(every("source"), *rest, "files").select("source", every("lang"), *(s for s in rest if not s.startswith("lang")), "files")
    meets = lambda c: (F.col(c) + reach >= F.col(f"{c}_min")) & (F.col(c) - reach <= F.col(f"{c}_max"))
    a, b = cells.select("z", *DIMENSIONS).alias("a"), keyed.alias("b")
    on = (F.col("a.source") == F.col("b.source")) & (F.col("a.lang") == F.col("b.lang")) & meets("length") & meets("date")
    return a.join(b.hint("merge"), on).groupBy("z").agg(F.sum("files").alias("files_touched"))


def clustered(docs: DataFrame, file_rows: int = FILE_ROWS, reach: int = REACH) -> DataFrame:
    """(doc_id, z, position, file, files_touched, files_matching, file_bounds) of each row of docs."""
    rows = stash(facts(docs))
    n, cuts = coordinates(rows)
    if not n:
        return docs.sparkSession.createDataFrame([], RESULT)
    placed = located(rows, cuts).withColumn("z", interleaved()).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("z"), F.col("doc_id"), F.col("row")]
    ranged = _ranged(placed, *order)
    sums = [tuple(r) for r in ranged.groupBy("part").count().collect()]
    position = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + _before(sums)
    numbered = stash(ranged.withColumn("position", position.cast("long")).withColumn("file", F.expr(f"position div {file_rows}")).drop("part", "row"))
    cells, files = stash(intervals(numbered, file_rows)), stash(bounds(numbered))
    queries = stash(matching(cells, reach).join(touched(cells, files, reach).hint("merge"), "z"))
    text = F.concat_ws(",", *(f"{c}_{x}" for c in DIMENSIONS for x in ("min", "max")))
    return (
        # files grow with the rows: neither join is left to a broadcast, and both stand where Spark splits a hot cell
        numbered.select("doc_id", "z", "position", "file").join(queries.hint("merge"), "z").join(files.select("file", text.alias("file_bounds")).hint("merge"), "file")
        .select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")
    )


def oracle() -> str:
    """The same as DuckDB SQL, for rows with distinct doc_id."""
    ranks = ", ".join(f"(rank() OVER (ORDER BY {c} NULLS FIRST) - 1) * {CELLS} // count(*) OVER () AS {c}" for c in DIMENSIONS)
    z = " + ".join(f"((({c} >> {b}) & 1) << {len(INTERLEAVED) * b + 3 - i})" for b in range(_BITS) for i, c in enumerate(INTERLEAVED))
    sides = ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in DIMENSIONS)
    text = ", ".join(f"{c}_{x}" for c in DIMENSIONS for x in ("min", "max"))
    equal = "f.source_min <= c.source AND f.source_max >= c.source AND f.lang_min <= c.lang AND f.lang_max >= c.lang"
    near = " AND ".join(f"f.{c}_min <= c.{c} + {REACH} AND f.{c}_max >= c.{c} - {REACH}" for c in ("length", "date"))
    match = "d.source = c.source AND d.lang = c.lang AND abs(d.length - c.length) <= 2 AND abs(d.date - c.date) <= 2"
    crc = "xor(c >> 8, list_extract(codes, 1 + (xor(c, x) & 255)::INT))"
    half = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    codes = "list_transform(range(256)::BIGINT[], lambda x: x)"
    for _ in range(8):
        codes = f"list_transform({codes}, lambda x: {half.format('x')})"
    return f"""
WITH codes AS MATERIALIZED (SELECT {codes} AS codes),
facts AS (
  SELECT doc_id, encode(source) AS source, encode(lang) AS lang, coalesce(strlen(text), -1) AS length,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: {crc})) % {DAYS} AS date
  FROM documents, codes),
located AS (SELECT doc_id, {ranks} FROM facts),
ordered AS (SELECT *, {z} AS z FROM located),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position, position // {FILE_ROWS} AS file FROM ordered),
files AS MATERIALIZED (SELECT file, {sides} FROM numbered GROUP BY file),
cells AS MATERIALIZED (SELECT DISTINCT z, {', '.join(DIMENSIONS)} FROM numbered),
spots AS MATERIALIZED (SELECT DISTINCT z, file, {', '.join(DIMENSIONS)} FROM numbered),
touch AS (SELECT c.z, count(*) AS files_touched FROM cells c JOIN files f ON {equal} AND {near} GROUP BY c.z),
meet AS (SELECT c.z, count(DISTINCT d.file) AS files_matching FROM cells c JOIN spots d ON {match} GROUP BY c.z)
SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, files_touched, files_matching, concat_ws(',', {text}) AS file_bounds
FROM numbered JOIN touch USING (z) JOIN meet USING (z) JOIN files USING (file)"""

"""Include graphs: resolve include commands against files, expand them in order, find cycles and leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, release

INCLUDE = r"\\(?:input|include|subfile|import|subimport)\s*(?:\{([^}]*)\}\s*)?\{([^}]+)\}"
#: A comment or an include command, whichever comes first: a command inside a comment is part of the comment.
PIECE = rf"(?m)(?<!\\)(?:\\\\)*%.*$|{INCLUDE}"


def include_edges(files: DataFrame) -> DataFrame:
    """(folder, src, pos, dst): include commands outside comments, targets with suffix; the first existing of the
    including file's directory and the folder wins. files(folder, name, text), names relative to the folder; pos is the
    command's place among the comments and includes of its file."""
    part = lambda n: F.regexp_extract_all("text", F.lit(PIECE), F.lit(n))
    found = files.select("folder", F.col("name").alias("src"), F.posexplode(F.arrays_zip(part(1).alias("dir"), part(2).alias("arg"))).alias("pos", "i")).where("i.arg <> ''")
    arg = F.trim(F.col("i.arg"))
    target = F.concat(F.coalesce("i.dir", F.lit("")), arg, F.when(arg.endswith(".tex"), "").otherwise(".tex"))
    here = F.regexp_extract("src", r"^(.*/)?", 0)
    tries = found.select("folder", "src", "pos", target.alias("wanted"), F.posexplode(F.array_distinct(F.array(F.concat(here, target), target))).alias("rank", "dst"))
    hit = tries.join(files.select("folder", F.col("name").alias("dst")), ["folder", "dst"])
    best = hit.groupBy("folder", "src", "pos").agg(F.min_by("dst", "rank").alias("dst"))
    return found.select("folder", "src", "pos", target.alias("wanted")).join(best, ["folder", "src", "pos"], "left")


def expand_order(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(folder, root, name, path, cycle): files reached from each root, depth first by path; a repeat on the way is a cycle.

    One join for each level of nesting, each level a table of its own, so none is computed twice; the levels are put together
    in one table in the end and deleted. The walk ends with the deepest include, as no path goes beyond a repeat. An include below
    max_depth, where that is given, is an error.
    """
    level = roots.select("folder", F.col("name").alias("root"), "name", F.array().cast("array<int>").alias("path"), F.array("name").alias("seen"), F.lit(False).alias("cycle"))
    out = level
    live = materialize(edges.where("dst IS NOT NULL").select("folder", F.col("src").alias("name"), "pos", "dst"))
    depth, made = 0, [live]
    while True:
        level = materialize(level.where("NOT cycle").join(live, ["folder", "name"]).select(
            "folder", "root", F.col("dst").alias("name"), F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"),
            F.concat("seen", F.array("dst")).alias("seen"), F.array_contains("seen", F.col("dst")).alias("cycle"),
        ))
        made.append(level)
        if level.isEmpty():
            whole = materialize(out.drop("seen"))
            release(*made)
            return whole
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"includes are nested more than {max_depth} deep")
        out = out.unionByName(level)


def reachable_sql(edges_view: str, roots_view: str) -> str:
    """The same as a recursive query, for engines and sessions that prefer it."""
    return f"""WITH RECURSIVE walk(folder, root, name, seen) AS (
  SELECT folder, name, name, array(name) FROM {roots_view}
  UNION ALL SELECT e.folder, w.root, e.dst, concat(w.seen, array(e.dst)) FROM walk w JOIN {edges_view} e ON e.folder = w.folder AND e.src = w.name
  WHERE e.dst IS NOT NULL AND NOT array_contains(w.seen, e.dst))
SELECT DISTINCT folder, root, name FROM walk"""


def leftovers(files: DataFrame, used: DataFrame) -> DataFrame:
    return files.join(used.select("folder", "name"), ["folder", "name"], "left_anti")


def inlined(files: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """(folder, root, text): each root with its includes in place, by one fold over the files it reaches, innermost first."""
    parts = order.where("NOT cycle").join(files.select("folder", "name", "text"), ["folder", "name"])
    rows = parts.groupBy("folder", "root").agg(F.collect_list(F.struct("path", "name", "text")).alias("parts"))
    innermost = F.reverse(F.array_sort("parts", lambda a, b: F.when(F.size(a["path"]) != F.size(b["path"]), F.size(a["path"]) - F.size(b["path"])).when(a["path"] < b["path"], -1).otherwise(1)))

    def step(acc, p):
        # children of p come before it: those whose path is p's and one place more, by that place
        kids = F.array_sort(F.filter(acc, lambda q: (F.size(q["path"]) == F.size(p["path"]) + 1) & (F.slice(q["path"], F.lit(1), F.size(p["path"])) == p["path"])))
        by_place = F.map_from_entries(F.transform(kids, lambda q: F.struct(F.element_at(q["path"], -1), q["text"])))
        bits, commands = F.split(p["text"], PIECE, -1), F.regexp_extract_all(p["text"], F.lit(PIECE), F.lit(0))
        done = F.array_join(F.zip_with(bits, F.transform(commands, lambda c, i: F.coalesce(F.try_element_at(by_place, i.cast("int")), c)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.concat(acc, F.array(F.struct(p["path"].alias("path"), p["name"].alias("name"), done.alias("text"))))

    zero = F.array().cast("array<struct<path:array<int>,name:string,text:string>>")
    return rows.select("folder", "root", F.aggregate(innermost, zero, step, lambda acc: F.element_at(acc, -1)["text"]).alias("text"))

"""Which files of a repository are read for routes: four tiers, each tried as the ones before have found little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions import columns as C

#: Files read of a repository, and how many the first tier has to find for the second to be left out.
MOST, ENOUGH = 30, 8


def tiers(path: Column, framework: str) -> Column:
    """The tiers that a path belongs to, as array<int>.

    0: a file that is always read, a known name at the top, or a matching file below a known folder; 1: a known name
    anywhere; 2: a matching file below a broad folder; 3: a matching file at the top.
    """
    known = fixed.ROUTE_SOURCES.get(framework, fixed.ROUTE_SOURCES["generic"])
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    top = F.size(parts) == 1
    fits = name.rlike(known["files"])
    named = name.isin(*known["names"])
    below = lambda dirs: F.arrays_overlap(folders, C.strings(tuple(dirs)))
    always = name.isin(*known["always"]) if known["always"] else F.lit(False)
    holds = (always | (top & named) | (below(known["dirs"]) & fits), named, fits & below(fixed.BROAD_DIRS), top & fits)
    return F.array_compact(F.array(*(F.when(h, F.lit(k)) for k, h in enumerate(holds))))


def route_files(tree: DataFrame, framework: str, repo: str = "repo_id", place: str = "place") -> DataFrame:
    """(repo, rank, path): at most 30 files to read of each repository, in order.

    tree: (repo, path, type, place in the listing); a repository's paths are distinct. Files that are always read come
    first, the last listed foremost; the others come as listed. The second tier is added where the first has fewer than
    8, the third and fourth where there is none yet. No repository's listing is gathered: each tier keeps its first 30
    within tasks, and the tiers' sizes as far as 8 are known from those.
    """
    known = fixed.ROUTE_SOURCES.get(framework, fixed.ROUTE_SOURCES["generic"])
    first = F.element_at(F.split("path", "/"), -1).isin(*known["always"]) if known["always"] else F.lit(False)
    rows = tree.filter("type = 'blob'").select(repo, "path", place, F.explode(tiers(F.col("path"), framework)).alias("tier"))
    rows = rows.withColumn("front", first & (F.col("tier") == 0)).withColumn("at", F.when(F.col("front"), -F.col(place)).otherwise(F.col(place)))
    near = Window.partitionBy(repo, "tier").orderBy(F.desc("front"), "at")
    kept = rows.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= MOST)
    one = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == k, F.struct("rank", "path")))), lambda x: x["path"])
    lists = kept.groupBy(repo).agg(*(one(k).alias(f"t{k}") for k in range(4)))
    wider = F.when(F.size("t0") < ENOUGH, F.array_union("t0", "t1")).otherwise(F.col("t0"))
    chosen = F.when(F.size(wider) > 0, wider).when(F.size("t2") > 0, F.col("t2")).otherwise(F.col("t3"))
    return lists.select(repo, F.posexplode(F.slice(chosen, 1, MOST)).alias("pos", "path")).select(repo, (F.col("pos") + 1).alias("rank"), "path")

"""Import graphs: keys of modules, resolution, edges, degrees, related files, bounded reach, confidence."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions import columns as C

#: Languages whose files can be imported; all share one index.
IMPORTED = ("python", "typescript", "javascript")
#: What a relative Python import may leave out of a file's path, and a script's of a key, best first.
FILE_ENDS, SCRIPT_ENDS = (".py", ".ts", ".js", ".tsx", ".jsx", "/__init__.py"), ("", ".ts", ".tsx", ".js", ".jsx")


def without_suffix(path: Column) -> Column:
    """A path without the last suffix of its name; a dot that begins or ends the name is none."""
    return F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def module_keys(files: DataFrame, repo: str = "repo_id", once: bool = True) -> DataFrame:
    """(repo, key, path): every name a file can be imported by.

    files: (repo, path, language). A Python file is known by its dotted path and, weakly, by each suffix of that; a
    script by its path without suffix, bare and after ./ and /, and weakly by its name. Of files with one whole name
    the last path holds it; what no file has as a whole name, the first path that claims it weakly. Keys that begin
    with "file:" name the files that hold any key, by their whole path; unless ``once``, a row for each key that the file
    holds, which saves a shuffle where equal rows do no harm.
    """
    rows = files.filter(F.col("language").isin(*IMPORTED)).select(repo, "path", (F.col("language") == "python").alias("_python"), without_suffix(F.col("path")).alias("_stem"))
    stem, python, depth, k = F.col("_stem"), F.col("_python"), F.col("_depth"), F.col("_k")
    # names are counted and each is then made in its own row, so that no list of them is built
    rows = rows.withColumn("_depth", F.when(python, _count(stem, "/") + 1)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.coalesce(depth, F.lit(4)))))
    dotted = F.replace(F.call_function("substring_index", stem, F.lit("/"), k - depth - 1), F.lit("/"), F.lit("."))
    key = F.when(python, dotted).when(k == 1, stem).when(k == 2, F.concat(F.lit("./"), stem)).when(k == 3, F.concat(F.lit("/"), stem)).otherwise(F.substring_index(stem, "/", -1))
    rows = rows.select(repo, "path", key.alias("key"), F.when(python, k == 1).otherwise(k < 4).alias("_whole"))
    index = rows.groupBy(repo, "key").agg(F.coalesce(F.max(F.when(F.col("_whole"), F.col("path"))), F.min("path")).alias("path"))
    # each key's row also says that its path holds one
    both = index.select(repo, F.explode(F.array("key", F.concat(F.lit("file:"), "path"))).alias("key"), "path")
    return both.groupBy(repo, "key").agg(F.first("path").alias("path")) if once else both


def _folded(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda a, x: F.when((x == ".") | (x == ""), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def candidates(imports: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """imports with (own, rank, key, ends): what to look up for the import, best first, and (own false) for the module that a Python import may name a member of.

    ``ends`` is the last place in the list of endings (``ended``) that the key may be found with, 0 for the first only.

    For a Python import, files beside the importer for a relative one, else all its suffixes. For a script's, aliases
    lose * and / at their end before they are compared, in their order, and the first that fits replaces. What several
    keys are made of is a column, so that it is worked out once for all of them.
    """
    raw, python, script = F.col("raw"), F.col("language") == "python", F.col("language").isin(*IMPORTED) & (F.col("language") != "python")
    bare = {a.rstrip("*").rstrip("/"): to.rstrip("*").rstrip("/") for a, to in aliases.items()}
    rest, at, stem, inside, path, parts, parent, k = (F.col(c) for c in ("_rest", "_at", "_stem", "_inside", "_path", "_parts", "_parent", "_k"))
    relative = python & F.startswith(raw, F.lit("."))
    replaced = F.coalesce(*[F.when(F.startswith(raw, F.lit(a)), F.concat(F.lit(to), F.substr(raw, F.lit(len(a) + 1)))) for a, to in bare.items()], raw)
    module = F.left(raw, F.length(raw) - F.length(F.substring_index(raw, ".", -1)) - 1)
    rows = imports.withColumns({"_rest": F.when(relative, F.ltrim(raw, F.lit("."))), "_path": F.when(script, replaced), "_parts": F.when(python & ~relative, _count(raw, ".") + 1), "_parent": F.when(python & ~relative, module)})
    beside = F.left(F.col("source"), F.length("source") - F.length(F.substring_index("source", "/", -1)) - 1)
    dirs = F.array_remove(F.split(beside, "/"), "")
    base = F.slice(dirs, 1, F.greatest(F.size(dirs) - (F.length(raw) - F.length(rest)) + 1, F.lit(0)))
    below = F.concat_ws("/", base, F.when(rest != "", F.replace(rest, F.lit("."), F.lit("/"))))
    rows = rows.withColumn("_at", F.when(relative, below).when(F.startswith(path, F.lit(".")), _folded(F.concat_ws("/", beside, path))))
    rows = rows.withColumns({"_stem": F.when(script, without_suffix(at)), "_inside": F.when(script, F.when(at == "", F.lit("index")).otherwise(F.concat(at, F.lit("/index"))))})
    # the lookups are counted and each is then made in its own row: an absolute name has one for each part, its module one less
    n = F.when(parts.isNotNull(), F.when(parent != "", 2 * parts - 1).otherwise(parts)).when(script, 2).otherwise(1)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    own = F.coalesce(k < parts, F.lit(True))
    key = (
        F.when(parts.isNotNull(), F.when(own, F.call_function("substring_index", raw, F.lit("."), k - parts)).otherwise(F.call_function("substring_index", parent, F.lit("."), k - 2 * parts + 1)))
        .when(relative, F.concat(F.lit("file:"), F.when(at == "", F.lit("__init__")).otherwise(at)))
        .when(script, F.when(at.isNotNull(), F.when(k == 0, stem).otherwise(inside)).otherwise(F.when(k == 0, path).otherwise(F.ltrim(path, F.lit("/")))))
    )
    ends = F.when(relative & (at != ""), len(FILE_ENDS) - 1).when(script & at.isNotNull(), len(SCRIPT_ENDS) - 1).otherwise(0)
    return rows.select(*imports.columns, own.alias("own"), ends.alias("ends"), F.when(own, k).otherwise(k - parts).alias("rank"), key.alias("key"))


def ended(index: DataFrame) -> DataFrame:
    """The index by keys less an ending that an import may leave out, with the ending's place in its list: an import is then one lookup, not one for each ending."""
    key = F.col("key")
    without = lambda e, k: F.struct(F.left(key, F.length(key) - len(e)).alias("key"), F.lit(k).alias("end"))
    # no key ends with two of the endings in one place here: /__init__.py with .py, and none with any other
    one = lambda ends, at: functools.reduce(lambda a, k: a.when(F.endswith(key, F.lit(ends[k])), without(ends[k], k)), at[1:], F.when(F.endswith(key, F.lit(ends[at[0]])), without(ends[at[0]], at[0])))
    file = F.startswith(key, F.lit("file:"))
    first = F.when(file, one(FILE_ENDS, range(len(FILE_ENDS) - 1))).otherwise(without("", 0))
    second = F.when(file, one(FILE_ENDS, [len(FILE_ENDS) - 1])).otherwise(one(SCRIPT_ENDS, range(1, len(SCRIPT_ENDS))))
    rows = index.withColumn("_k", F.explode(F.array(first, second))).filter("_k is not null")
    return rows.withColumn("key", F.col("_k.key")).withColumn("end", F.col("_k.end")).drop("_k")


def unresolved_reason(raw: Column, language: Column, aliases: list[str]) -> Column:
    """Why an import names no file: built dynamically, by an alias unknown here, a package's folder, or a file not scanned."""
    among = lambda found: functools.reduce(Column.__or__, found, F.lit(False))
    dynamic = among(F.contains(raw, F.lit(m)) for m in fixed.DYNAMIC_MARKS)
    known = among(F.startswith(raw, F.lit(a.rstrip("*"))) for a in aliases)
    dotted = F.ltrim(raw, F.lit("."))
    folder = (language == "python") & F.contains(dotted, F.lit(".")) & F.lower(F.substring_index(dotted, ".", -1)).isin(*fixed.PACKAGE_FOLDERS)
    return F.when(dynamic, "dynamic_import").when((language != "python") & ~known & F.startswith(raw, F.lit("@")), "alias_unknown").when(folder, "ambiguous_package_import").otherwise("file_not_scanned")


def _met(asked: DataFrame, answers: DataFrame, repo: str) -> DataFrame:
    """asked with the answer of least end to its key, if that is among its ends, from answers (repo, key, end, path)."""
    rows = asked.withColumn("_asked", F.lit(True)).unionByName(answers.select(repo, "key", F.struct("end", "path").alias("_answer")), allowMissingColumns=True)
    rows = rows.withColumn("_best", F.min("_answer").over(Window.partitionBy(repo, "key"))).filter("_asked")
    # files of a null repository answer nothing, as in a join
    fits = F.col(repo).isNotNull() & (F.col("_best.end") <= F.col("ends"))
    return rows.select(*asked.columns, F.when(fits, F.col("_best.end")).alias("end"), F.when(fits, F.col("_best.path")).alias("hit"))


def hits(imports: DataFrame, index: DataFrame, aliases: dict[str, str] | None = None, repo: str = "repo_id", how: str = "inner", dealt: bool = False) -> DataFrame:
    """imports that any lookup finds, or all of them (``how`` left), with (target, member): the file of the first key that the index has, be it the importer, and whether the module that the import may name a member of is one.

    imports: (repo, source, language, raw); equal ones become one. One join looks up all keys of an import and of its module; what
    was found is gathered by import, so that the imports themselves are not read again. Where both inputs are ``dealt`` by
    ``repo`` to equally many partitions, keys meet and imports are gathered where they are: a join would shuffle both inputs by
    its other key too, a union of them under a window does not.
    """
    asked = candidates(imports, fixed.SCRIPT_ALIASES if aliases is None else aliases)
    answers = ended(index)
    if dealt:
        found = _met(asked, answers, repo)
        found = found if how == "left" else found.filter("hit is not null")
    else:
        answers = answers.select(F.col(repo).alias("_repo"), F.col("key").alias("_key"), "end", F.col("path").alias("hit"))
        found = asked.join(answers, (F.col(repo) == F.col("_repo")) & (F.col("key") == F.col("_key")) & (F.col("end") <= F.col("ends")), how)
    # an import's first lookup stands for it where none finds a file
    found = found.filter("hit is not null or (own and rank = 0)")
    place = F.when(F.col("own"), F.col("rank") * max(len(FILE_ENDS), len(SCRIPT_ENDS)) + F.col("end"))
    found = found.select(*imports.columns, "hit", place.alias("place"), (~F.col("own") & F.col("hit").isNotNull()).alias("member"))
    # else dealt before they are gathered: an import has hardly more rows than one, which gathering them twice would only sort twice
    found = found if dealt else found.repartition(repo, "source")
    return found.groupBy(*imports.columns).agg(F.min_by("hit", "place").alias("target"), F.bool_or("member").alias("member"))


def resolve(imports: DataFrame, index: DataFrame, external: tuple[str, ...] = fixed.EXTERNAL_ROOTS, aliases: dict[str, str] | None = None, repo: str = "repo_id", dealt: bool = False) -> DataFrame:
    """Edges (repo, source, raw, target, confidence, reason): the first key that the index has wins.

    imports: (repo, source, language, raw); equal ones become one. A Python import that no file answers, of a module that one does,
    names a member and is left out. ``dealt`` as for hits. What no file but the importer answers is external where its root is a known
    package (no edge), else unresolved with a reason.
    """
    aliases = fixed.SCRIPT_ALIASES if aliases is None else aliases
    rows = hits(imports, index, aliases, repo, "left", dealt).filter("target is not null or not member")
    rows = rows.withColumn("target", F.when(F.col("target") != F.col("source"), F.col("target")))
    named = F.ltrim(F.col("raw"), F.lit("."))
    first = F.substring_index(named, "/", 1)
    root = F.lower(F.when(F.startswith(named, F.lit("@")), first).otherwise(F.substring_index(first, ".", 1)))
    rows = rows.filter(F.col("target").isNotNull() | ~root.isin(*external))
    reason = F.when(F.col("target").isNull(), unresolved_reason(F.col("raw"), F.col("language"), list(aliases)))
    return rows.select(repo, "source", "raw", "target", F.when(F.col("target").isNotNull(), "confirmed").otherwise("unresolved").alias("confidence"), reason.alias("reason"))


def degrees(edges: DataFrame, repo: list[str]) -> DataFrame:
    """Callers and callees of each file, distinct."""
    known = edges.filter("target is not null").select(*repo, "source", "target").distinct()
    i = known.groupBy(*repo, F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("callers"))
    o = known.groupBy(*repo, F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("callees"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return i.join(o, [*repo, "path"], "full").select(*repo, "path", zero("callers"), zero("callees"))


def related(items: DataFrame, group: list[str], item: str, n: int = 5) -> DataFrame:
    """The first n other items of an item's group: (item, related, rank).

    Only the n + 1 first items of a group can be related to any, so no item meets its whole group.
    """
    first = items.select(*group, F.col(item).alias("related")).withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy("related"))).filter(F.col("pos") <= n + 1)
    pairs = items.select(*group, item).join(first, group).filter(F.col(item) != F.col("related"))
    rank = F.row_number().over(Window.partitionBy(*group, item).orderBy("related"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= n).select(item, "related", "rank")


def reach(edges: DataFrame, starts: DataFrame, repo: list[str], depth: int = 2) -> DataFrame:
    """(repo, path, depth) reachable from any start within depth steps, by unrolled joins."""
    known = edges.filter("target is not null").select(*repo, "source", "target").distinct()
    level = starts.select(*repo, "path").distinct().withColumn("depth", F.lit(0))
    out = level
    for k in range(1, depth + 1):
        step = known.withColumnRenamed("source", "path")
        level = level.drop("depth").join(step, [*repo, "path"]).select(*repo, F.col("target").alias("path")).distinct().withColumn("depth", F.lit(k))
        out = out.unionByName(level)
    return out.groupBy(*repo, "path").agg(F.min("depth").alias("depth"))


def confidence(edges: DataFrame, repo: list[str]) -> DataFrame:
    """Confirmed share of internal edges by repo to three places, dynamic imports not counted, 0.5 for none."""
    counted = F.coalesce(F.col("reason") != "dynamic_import", F.lit(True))
    share = F.try_divide(F.count_if(F.col("confidence") == "confirmed"), F.count_if(counted))
    return edges.groupBy(*repo).agg(F.coalesce(C.rounded(share, 3), F.lit(0.5)).alias("graph_confidence"), F.count_if(F.col("confidence") == "confirmed").alias("confirmed"), F.count_if(F.col("confidence") != "confirmed").alias("unresolved"))


def unresolved_by_reason(edges: DataFrame, repo: list[str]) -> DataFrame:
    return edges.filter("target is null").groupBy(*repo, "reason").agg(F.count(F.lit(1)).alias("n"))


def visible(edges: DataFrame, shown: DataFrame, repo: list[str]) -> DataFrame:
    """Edges both ends of which are shown."""
    s = shown.select(*repo, F.col("path").alias("source")).distinct()
    t = shown.select(*repo, F.col("path").alias("target")).distinct()
    return edges.join(s, [*repo, "source"], "left_semi").join(t, [*repo, "target"], "left_semi")

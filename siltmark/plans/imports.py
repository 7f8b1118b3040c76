"""Import graphs over repositories made of the driver's tables: each order puts one file of a pool into its customer's repository.

What a file imports is fixed by its text, which Spark parses; what an import finds depends on the other files there. The
SQL states each text's imports and the rules of resolution on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..catalog import query, spread, table
from ..functions import parse
from ..operators import graph

#: (path, language, text, imports as they are read off the text)
POOL = (
    ("shop/main.py", "python", "import os\nfrom shop.api import orders\nfrom shop.settings import debug\nimport shop.missing\nfrom PIL import image\n", ("os", "shop.api", "shop.api.orders", "shop.settings", "shop.settings.debug", "shop.missing", "PIL", "PIL.image")),
    ("shop/settings.py", "python", "import settings\nfrom util import helper\nimport a.x.util\n", ("settings", "util", "util.helper", "a.x.util")),
    ("shop/api/__init__.py", "python", "from . import orders\nfrom .. import db\n", (".", "..orders", "..", "...db")),
    ("shop/api/orders.py", "python", "from .helpers import save\nfrom ..db import session\nimport importlib.util\nfrom services import billing\n", (".helpers", ".helpers.save", "..db", "..db.session", "importlib.util", "services", "services.billing")),
    ("shop/api/helpers.py", "python", "from shop.models import order\nimport x.models\nimport logging.handlers\n", ("shop.models", "shop.models.order", "x.models", "logging.handlers")),
    ("shop/db.py", "python", "import PIL\nfrom pkg.sub import money\nfrom ...far import thing\n", ("PIL", "pkg.sub", "pkg.sub.money", "...far", "...far.thing")),
    ("shop/models/order.py", "python", "from .x import y\nimport order\n", (".x", ".x.y", "order")),
    ("other/pkg/x.py", "python", "import shop\nimport main\n", ("shop", "main")),
    ("a/x/util.py", "python", "from .util import me\n", (".util", ".util.me")),
    ("b/util.py", "python", "from shop.settings import thing\nimport b.util\n", ("shop.settings", "shop.settings.thing", "b.util")),
    ("main.py", "python", "import app\nfrom . import db\n", ("app", ".", "..db")),
    ("app.ts", "typescript", 'import { a } from "./lib/money";\nimport b from "shop/main";\n', ("./lib/money", "shop/main")),
    ("lib/money.ts", "typescript", 'import { c } from "money";\nimport d from "/app";\nimport e from "@/cart/list";\n', ("money", "/app", "@/cart/list")),
    ("src/cart/list.ts", "typescript", 'import { price } from "../money";\nimport x from "@components/Cart";\nimport y from "@scope/pkg";\nimport r from "react";\n', ("../money", "@components/Cart", "@scope/pkg", "react")),
    ("src/money/index.ts", "typescript", 'import l from "../cart/list.service";\nimport m from ".";\nimport t from "~/tool";\n', ("../cart/list.service", ".", "~/tool")),
    ("src/tool.ts", "typescript", 'import q from "../../../app";\nimport z from "./tool";\nimport w from "@tanstack/react-query";\n', ("../../../app", "./tool", "@tanstack/react-query")),
    ("app.js", "javascript", 'import a from "./src/money";\nimport g from "./gone";\n', ("./src/money", "./gone")),
    ("web/page.tsx", "typescript", 'import k from "../src/cart/list";\nimport u from "b.util";\nimport v from "list";\n', ("../src/cart/list", "b.util", "list")),
    ("docs/guide.md", "markdown", "import nothing\n", ()),
)
ENTRIES = ("shop/main.py", "main.py", "app.ts")


def _pool_sql() -> str:
    return ", ".join(f"({k}, '{path}', '{language}', [{', '.join(map(repr, raws))}]::VARCHAR[])" for k, (path, language, _, raws) in enumerate(POOL))


EXTENSIONS, SCRIPT_EXTENSIONS = "['.py', '.ts', '.js', '.tsx', '.jsx', '/__init__.py']", "['', '.ts', '.tsx', '.js', '.jsx']"
_ALIAS = "CASE " + " ".join(f"WHEN starts_with(name, '{a.rstrip('/')}') THEN '{to.rstrip('/')}' || substr(name, {len(a.rstrip('/')) + 1})" for a, to in fixed.SCRIPT_ALIASES.items()) + " ELSE name END"
_UP = "list_reduce(list_prepend('', string_split(dir || '/' || p, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN x ELSE a || '/' || x END)"
_KNOWN_ALIAS = " OR ".join(f"starts_with(raw, '{a}')" for a in fixed.SCRIPT_ALIASES)
_STEM = "regexp_replace({0}, '([^/])\\.[^./]+$', '\\1')"
EDGES = rf"""pool(n, path, language, raws) AS (VALUES {_pool_sql()}),
f AS (SELECT DISTINCT o_custkey AS repo_id, path, language, raws FROM orders JOIN pool ON (o_orderkey * 7 + o_custkey) % {len(POOL)} = n),
stems AS (SELECT *, {_STEM.format("path")} AS stem FROM f WHERE language <> 'markdown'),
claims AS (SELECT repo_id, path, replace(stem, '/', '.') AS key, true AS whole FROM stems WHERE language = 'python'
  UNION ALL SELECT repo_id, path, array_to_string(string_split(stem, '/')[unnest(range(2, len(string_split(stem, '/')) + 1)):], '.'), false FROM stems WHERE language = 'python'
  UNION ALL SELECT repo_id, path, unnest([stem, './' || stem, '/' || stem]), true FROM stems WHERE language <> 'python'
  UNION ALL SELECT repo_id, path, string_split(stem, '/')[-1], false FROM stems WHERE language <> 'python'),
idx AS (SELECT repo_id, key, coalesce(max(path) FILTER (whole), min(path)) AS path FROM claims GROUP BY repo_id, key),
held AS (SELECT DISTINCT repo_id, path FROM idx),
imp AS (SELECT DISTINCT repo_id, path AS source, language, unnest(raws) AS raw FROM stems),
named AS (SELECT *, raw AS name, true AS own FROM imp UNION ALL SELECT *, regexp_extract(raw, '^(.+)\.[^.]*$', 1), false FROM imp WHERE language = 'python' AND NOT starts_with(raw, '.') AND contains(raw, '.')),
py AS (SELECT *, length(regexp_extract(name, '^\.*')) AS dots, regexp_replace(name, '^\.+', '') AS rest, string_split(name, '.') AS parts, string_split(source, '/')[:-2] AS dirs FROM named WHERE language = 'python'),
py_at AS (SELECT *, array_to_string(list_concat(dirs[:greatest(0, len(dirs) - dots + 1)], CASE WHEN rest = '' THEN [] ELSE string_split(rest, '.') END), '/') AS loc FROM py),
beside AS (SELECT p.repo_id, source, raw, own, r AS rank, held.path AS hit FROM (SELECT *, unnest(range(1, 7)) AS r FROM py_at WHERE dots > 0) p
  JOIN held ON held.repo_id = p.repo_id AND held.path = CASE WHEN loc = '' THEN CASE WHEN r = 6 THEN '__init__.py' END ELSE loc || {EXTENSIONS}[r] END),
absolute AS (SELECT p.repo_id, source, raw, own, r AS rank, idx.path AS hit FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS r FROM py_at WHERE dots = 0) p
  JOIN idx ON idx.repo_id = p.repo_id AND idx.key = array_to_string(parts[r:], '.')),
js AS (SELECT *, {_ALIAS} AS p, array_to_string(string_split(source, '/')[:-2], '/') AS dir FROM named WHERE language <> 'python'),
js_at AS (SELECT *, CASE WHEN starts_with(p, '.') THEN {_UP} END AS loc FROM js),
js_keys AS (SELECT repo_id, source, raw, own, r AS rank, CASE WHEN loc IS NULL THEN [p, regexp_replace(p, '^/+', '')][r] WHEN r <= 5 THEN {_STEM.format("loc")} || {SCRIPT_EXTENSIONS}[r]
  ELSE CASE WHEN loc = '' THEN 'index' ELSE loc || '/index' END || {SCRIPT_EXTENSIONS}[r - 5] END AS key FROM (SELECT *, unnest(range(1, 11)) AS r FROM js_at)),
scripts AS (SELECT k.repo_id, source, raw, own, rank, idx.path AS hit FROM js_keys k JOIN idx ON idx.repo_id = k.repo_id AND idx.key = k.key),
hits AS (SELECT * FROM beside UNION ALL SELECT * FROM absolute UNION ALL SELECT * FROM scripts),
best AS (SELECT repo_id, source, raw, arg_min(hit, rank) FILTER (own) AS target, bool_or(NOT own) AS member FROM hits GROUP BY repo_id, source, raw),
placed AS (SELECT imp.*, CASE WHEN target <> imp.source THEN target END AS target, target IS NULL AND coalesce(member, false) AS dropped,
  CASE WHEN starts_with(ltrim(imp.raw, '.'), '@') THEN string_split(imp.raw, '/')[1] ELSE string_split(string_split(ltrim(imp.raw, '.'), '.')[1], '/')[1] END AS root
  FROM imp LEFT JOIN best ON best.repo_id = imp.repo_id AND best.source = imp.source AND best.raw = imp.raw),
edges AS (SELECT repo_id, source, raw, target, CASE WHEN target IS NULL THEN CASE WHEN contains(raw, 'importlib') THEN 'dynamic_import'
  WHEN language <> 'python' THEN CASE WHEN starts_with(raw, '@') AND NOT ({_KNOWN_ALIAS}) THEN 'alias_unknown' ELSE 'file_not_scanned' END
  WHEN contains(ltrim(raw, '.'), '.') AND list_contains([{', '.join(map(repr, fixed.PACKAGE_FOLDERS))}], lower(string_split(raw, '.')[-1])) THEN 'ambiguous_package_import' ELSE 'file_not_scanned' END END AS reason
  FROM placed WHERE NOT dropped AND (target IS NOT NULL OR NOT list_contains([{', '.join(map(repr, fixed.EXTERNAL_ROOTS))}], lower(root))))"""


#: Orders whose files a task has at most, on average: some hundred MB of keys to sort, which fit its memory.
TASK_ORDERS = 200_000


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(repo_id, path, language, content), dealt by repository: what a repository's files say of each other needs no other shuffle."""
    pool = spark.createDataFrame([(k, p, language, text) for k, (p, language, text, _) in enumerate(POOL)], "n int, path string, language string, content string")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo_id"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % len(POOL)).cast("int").alias("n"))
    # the count is in the file's footers
    return spread(orders, "repo_id", least=orders.count() // TASK_ORDERS + 1).distinct().join(F.broadcast(pool), "n").drop("n")


def imports_of(rows: DataFrame) -> DataFrame:
    """(repo_id, source, language, raw) as python_imports and script_imports read them, one row for each; a file that names a module twice may give it twice."""
    python, line, module, name = F.col("language") == "python", F.col("_line"), F.col("_module"), F.col("_name")
    # a Python file's lines are rows before they are looked at, instead of lists that are filtered and matched by functions of lists
    found = F.when(~python & (F.col("language") != "markdown"), F.array_distinct(parse.script_imports(F.col("content")))).when(python, parse.python_lines(F.col("content")))
    lines = rows.select("repo_id", F.col("path").alias("source"), "language", F.explode(found).alias("_line")).withColumn("_line", F.when(python, F.trim(line, F.lit(" \t"))).otherwise(line))
    lines = lines.filter(~python | F.startswith(line, F.lit("from")) | F.startswith(line, F.lit("import")))
    # one match gives module and names: "," and both with a comma between them, which no line that is not matched begins with
    lines = lines.withColumn("_from", F.when(python, F.regexp_replace(line, parse.FROM_IMPORT, ",$1,$2")))
    lines = lines.withColumn("_module", F.when(python, F.when(F.startswith("_from", F.lit(",")), F.substring_index(F.substr("_from", F.lit(2)), ",", 1)).otherwise("")))
    # the empty name before the first is the module itself
    names = F.when(module != "", F.substr("_from", F.length(module) + 2)).when(python, F.regexp_extract("_line", parse.BARE_IMPORT, 1))
    named = lines.withColumn("_name", F.explode(F.when(python, F.split(names, ",")).otherwise(F.array(line)))).withColumn("_name", F.when(python, F.trim("_name")).otherwise(name))
    member = F.when(name == "", module).when(name.rlike(r"^\p{Ll}") & ~F.contains(name, F.lit(".")), F.concat(module, F.lit("."), name))
    bare = F.trim(F.substring_index(name, " as ", 1))
    raw = F.when(module != "", member).when(python, F.when(bare != "", bare)).otherwise(name)
    return named.select("repo_id", "source", "language", raw.alias("raw")).filter("raw is not null")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf)
    return graph.resolve(imports_of(rows), graph.module_keys(rows, once=False), dealt=True)


@query(f"WITH {EDGES} SELECT repo_id, source, raw, target, reason FROM edges")
def import_edges(spark, sf):
    """Imports resolved to files, or why not."""
    return edges(spark, sf).select("repo_id", "source", "raw", "target", "reason")


@query(
    f"""WITH {EDGES}, e AS (SELECT DISTINCT repo_id, source, target FROM edges WHERE target IS NOT NULL),
d0 AS (SELECT repo_id, path, 0 AS depth FROM f WHERE path IN ({', '.join(map(repr, ENTRIES))})), d1 AS (SELECT d0.repo_id, target AS path, 1 AS depth FROM d0 JOIN e ON e.repo_id = d0.repo_id AND source = path),
d2 AS (SELECT d1.repo_id, target AS path, 2 AS depth FROM d1 JOIN e ON e.repo_id = d1.repo_id AND source = path)
SELECT repo_id, path, min(depth)::INT AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY repo_id, path"""
)
def critical_path(spark, sf):
    """Files within two imports of an entrypoint."""
    rows = files(spark, sf)
    # entries are joined, since a filter by them would be inferred for the first step's edges too, which the second would then not share
    starts = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in ENTRIES], "path string")), "path", "left_semi")
    found = graph.hits(imports_of(rows), graph.module_keys(rows, once=False), dealt=True).filter("target <> source")
    return graph.reach(found, starts, ["repo_id"]).select("repo_id", "path", "depth")


@query(
    f"""WITH {EDGES}, n AS (SELECT repo_id, count(*) FILTER (target IS NOT NULL) AS confirmed, count(*) FILTER (target IS NULL) AS unresolved, count(*) FILTER (reason IS DISTINCT FROM 'dynamic_import') AS counted FROM edges GROUP BY repo_id)
SELECT repo_id, coalesce(format('{{:.3f}}', confirmed / nullif(counted, 0))::DOUBLE, 0.5) AS graph_confidence, confirmed, unresolved FROM n"""
)
def graph_confidence(spark, sf):
    """Confirmed share of imports."""
    return graph.confidence(edges(spark, sf), ["repo_id"])

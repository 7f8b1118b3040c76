"""Import resolution: queries against SQL, odd cases against rows stated by hand."""

from pyspark.sql import functions as F

from siltmark.functions import parse
from siltmark.operators import graph
from siltmark.plans import imports


def test_texts_hold_the_imports_that_sql_states(spark):
    rows = spark.createDataFrame([(p, language, text) for p, language, text, _ in imports.POOL if language != "markdown"], "path string, language string, content string")
    raw = F.when(F.col("language") == "python", parse.python_imports(F.col("content"))).otherwise(parse.script_imports(F.col("content")))
    got = {r.path: set(r.raws) for r in rows.select("path", raw.alias("raws")).collect()}
    assert got == {p: set(raws) for p, language, _, raws in imports.POOL if language != "markdown"}


def resolved(spark, paths, tries):
    kind = lambda p: "python" if p.endswith(".py") else "typescript" if p.endswith((".ts", ".tsx")) else "javascript"
    files = spark.createDataFrame([(1, p, kind(p)) for p in paths], "repo_id int, path string, language string")
    rows = spark.createDataFrame([(1, s, kind(s), r) for s, r in tries], "repo_id int, source string, language string, raw string")
    return {(r.source, r.raw): r.target or r.reason for r in graph.resolve(rows, graph.module_keys(files)).collect()}


def test_odd_cases(spark):
    paths = ("a/x/util.py", "b/util.py", "pkg/a.py", "other/pkg/x.py", "shop/api/__init__.py", "shop/api/orders.py", "shop/main.py", "src/tool.ts", "lib/money.ts", "app.js", "app.ts", "lib/a.service.ts", "lib/a.ts", "src/ui/index.tsx", "m/same.py")
    want = {
        ("pkg/a.py", "util"): "a/x/util.py",  # the first path that claims a suffix
        ("pkg/a.py", ".x"): "file_not_scanned",  # a relative import never takes a suffix
        ("shop/main.py", "shop.api"): "ambiguous_package_import",  # a package's own file is not its name
        ("shop/main.py", "shop.api.orders"): "shop/api/orders.py",
        ("shop/main.py", "..db.session"): "file_not_scanned",
        ("shop/api/orders.py", "."): "shop/api/__init__.py",
        ("shop/main.py", "PIL"): "file_not_scanned",  # not among the compared roots
        ("m/same.py", "same"): "file_not_scanned",  # itself
        ("shop/main.py", "importlib.zz"): None,
        ("shop/main.py", "no.models"): "ambiguous_package_import",
        ("lib/a.ts", "~/tool"): "src/tool.ts",
        ("lib/a.ts", "@components/Cart"): "file_not_scanned",
        ("lib/a.ts", "@scope/x"): "alias_unknown",
        ("lib/a.ts", "money"): "lib/money.ts",
        ("lib/a.ts", "./a.service"): "file_not_scanned",  # .service goes as a suffix, and a is the importer
        ("src/tool.ts", "../lib/a.service"): "lib/a.ts",
        ("src/tool.ts", "./ui"): "src/ui/index.tsx",
        ("lib/a.ts", "../app"): "app.ts",  # of two files with one whole name the last
        ("lib/a.ts", "/app"): "app.ts",
        ("lib/a.ts", "@/tool"): "src/tool.ts",
        ("lib/a.ts", "react"): None,
    }
    got = resolved(spark, paths, list(want))
    assert got == {k: v for k, v in want.items() if v}


def test_member_imports_go_only_where_the_module_is_a_file(spark):
    got = resolved(spark, ("shop/settings.py", "x.py"), [("x.py", "shop.settings"), ("x.py", "shop.settings.debug"), ("x.py", "shop.other.debug"), ("x.py", ".shop.settings.debug")])
    assert got == {("x.py", "shop.settings"): "shop/settings.py", ("x.py", "shop.other.debug"): "file_not_scanned", ("x.py", ".shop.settings.debug"): "file_not_scanned"}


def test_empty(spark):
    files = spark.createDataFrame([], "repo_id int, path string, language string")
    rows = spark.createDataFrame([(1, "x.py", "python", "y")], "repo_id int, source string, language string, raw string")
    assert [r.reason for r in graph.resolve(rows, graph.module_keys(files)).collect()] == ["file_not_scanned"]


def parses(df):
    """How often the plan that ran parsed the files."""
    df.collect()
    ran = str(df._jdf.queryExecution().executedPlan()).split("== Initial Plan ==")[0]
    return sum("Generate explode(" in x and "export" in x for x in ran.splitlines())


def test_critical_path_parses_each_file_once(spark, sf):
    assert parses(imports.critical_path(spark, sf)) == 1


def test_graph_confidence_parses_each_file_once(spark, sf):
    assert parses(imports.graph_confidence(spark, sf)) == 1


def test_import_edges_parses_each_file_once(spark, sf):
    assert parses(imports.import_edges(spark, sf)) == 1


def test_an_import_is_one_lookup_whatever_ending_it_leaves_out(spark):
    rows = spark.createDataFrame([(1, "a/b.py", "python", ".c"), (1, "a/b.ts", "typescript", "./c"), (1, "a/b.py", "python", "x.y")], "repo_id int, source string, language string, raw string")
    got = {(r.raw, r.own, r["rank"], r.key, r.ends) for r in graph.candidates(rows, {}).collect()}
    assert got == {(".c", True, 0, "file:a/c", 5), ("./c", True, 0, "a/c", 4), ("./c", True, 1, "a/c/index", 4), ("x.y", True, 0, "x.y", 0), ("x.y", True, 1, "y", 0), ("x.y", False, 0, "x", 0)}


def test_endings_keep_their_order(spark):
    paths = ("m/__init__.py", "m/a.ts", "m/a.py", "m/b/__init__.py", "m/b.jsx", "m/c.py.ts", "s/x/ts.py", "s/d.ts", "s/d/index.js", "s/e/index.tsx", "__init__.ts")
    want = {
        ("m/__init__.py", ".a"): "m/a.py", ("m/a.py", ".b"): "m/b.jsx", ("m/a.py", ".c.py"): "file_not_scanned", ("m/a.py", ".b.__init__"): "m/b/__init__.py",
        ("m/a.py", ".."): "file_not_scanned",  # only a folder's __init__.py is the folder
        ("s/d.ts", "./e"): "s/e/index.tsx", ("s/e/index.tsx", "../d"): "s/d.ts", ("s/e/index.tsx", "../d/index"): "s/d/index.js", ("m/a.ts", "c.py"): "m/c.py.ts",
    }
    assert resolved(spark, paths, list(want)) == want


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_imports_are_gathered_from_their_lookups_and_not_joined_again(spark):
    files = spark.createDataFrame([(1, "a/b.py", "python")], "repo_id int, path string, language string")
    rows = spark.createDataFrame([(1, "a/b.py", "python", "x.y"), (1, "a/b.py", "python", "x.y"), (1, "z.go", "go", "q")], "repo_id int, source string, language string, raw string")
    edges = graph.resolve(rows, graph.module_keys(files))
    assert joins(edges) == 1
    assert sorted((r.source, r.raw, r.reason) for r in edges.collect()) == [("a/b.py", "x.y", "file_not_scanned"), ("z.go", "q", "file_not_scanned")]


def test_index_of_files_dealt_by_repository_needs_no_shuffle(spark, sf):
    files = imports.files(spark, sf)
    shuffles = lambda df: str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")
    assert shuffles(graph.module_keys(files, once=False)) == shuffles(files)


def test_lines_as_rows_give_the_modules_of_lists(spark):
    texts = ("from a.b import x, Y, z as w # c", "from x import  # c", "from x import # c", "\timport a, b.c as d,e  ", "import a as b # q\rimport os # c as d", "from . import (a\x0bfrom .. import *\x1cfrom x import a,,b,", "fromage\nimports x", "import é from é import b", None)
    files = spark.createDataFrame([(1, str(k), "python", x) for k, x in enumerate(texts)], "repo_id int, path string, language string, content string")
    want = files.select("path", F.explode(F.array_distinct(parse.python_imports(F.col("content")))).alias("raw"))
    assert {tuple(r) for r in want.collect()} == {(r.source, r.raw) for r in imports.imports_of(files).collect()}


def test_edges_are_found_without_a_shuffle_where_files_are_dealt_by_repository(spark, sf):
    """the keys of all imports and files, and what was found, went through an exchange each."""
    shuffles = lambda df: str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")
    # files are read for their imports and for their keys; the two are one exchange when it runs
    assert shuffles(imports.import_edges(spark, sf)) == 2 * shuffles(imports.files(spark, sf)) == 2


def test_dealt_inputs_give_the_edges_of_a_join(spark):
    paths = ("m/__init__.py", "m/a.ts", "m/a.py", "m/b/__init__.py", "m/b.jsx", "m/c.py.ts", "s/d.ts", "s/d/index.js", "s/e/index.tsx", "app.js", "app.ts", "a/x/util.py", "b/util.py", "__init__.py")
    kind = lambda p: "python" if p.endswith(".py") else "typescript" if p.endswith((".ts", ".tsx")) else "javascript"
    raws = {True: (".", "..", "..a", ".b", ".a", "util", "x.util", "a.x.util.f", "m.a", "m.a.b", "no.models", "os", "c.py", ""), False: ("./e", "../e", "./d", "../app", "./app", "/app", "money", "a", "@/a", "@scope/p", "react", "util", ".", "..", "file:m/a", "")}
    files = spark.createDataFrame([(r, p, kind(p)) for r in (1, 2, None) for k, p in enumerate(paths) if r != 2 or k % 2], "repo_id int, path string, language string")
    tries = [(r, p, kind(p), raw) for r in (1, 2, 3, None) for p in paths for raw in raws[p.endswith(".py")]] + [(1, "z.go", "go", "q"), (1, "m/a.py", "python", "util")]
    rows = spark.createDataFrame(tries, "repo_id int, source string, language string, raw string")
    for once in (True, False):
        index = graph.module_keys(files, once=once)
        assert sorted(map(str, graph.resolve(rows, index, dealt=True).collect())) == sorted(map(str, graph.resolve(rows, index).collect()))
        assert sorted(map(str, graph.hits(rows, index, dealt=True).collect())) == sorted(map(str, graph.hits(rows, index).collect()))


def test_files_are_dealt_to_more_tasks_as_orders_grow(spark, sf, monkeypatch):
    """64 tasks spilled 16 GB over 54 million orders."""
    monkeypatch.setattr(imports, "TASK_ORDERS", 100)
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    files = imports.files(spark, sf)
    assert orders > 1000
    assert f", {orders // 100 + 1}), REPARTITION_BY_NUM" in str(files._jdf.queryExecution().executedPlan())

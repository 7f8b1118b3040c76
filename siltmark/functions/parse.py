"""Whole-file parses as columns: imports, definitions, exports, flags, complexity. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from . import columns as C

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
FROM_IMPORT = r"^from\s+([\w.]+)\s+import\s+([\w\s,*]+?)(?:\s*#.*)?$"
BARE_IMPORT = r"^import\s+([\w., ]+?)(?:\s*#.*)?(?:\s+as\s+\w+)?$"
SCRIPT_FROM = r"""(?m)^(?:import|export)\s+.*?\s+from\s+['"]([^'"]+)['"]"""
SCRIPT_ALL = r"""(?m)^export\s+\*\s+from\s+['"]([^'"]+)['"]"""


def text_lines(text: Column) -> Column:
    """Lines by any line end; a last one that is empty is no line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def solid_lines(text: Column, comment: str | None = "#") -> Column:
    """Lines that are neither blank nor begin with a comment mark."""
    return F.filter(text_lines(text), lambda x: x.rlike(r"\S") & (~x.rlike(rf"^\s*{comment}") if comment else F.lit(True)))


def loc(text: Column, comment: str | None = "#") -> Column:
    return F.size(solid_lines(text, comment))


def nesting(text: Column, width: int = 4) -> Column:
    """Deepest indent, in steps of width, of a line that is neither blank nor a comment; a tab is one character."""
    deepest = F.array_max(F.transform(solid_lines(text), lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1))))
    return F.coalesce(F.floor(deepest / width), F.lit(0)).cast("int")


def count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def groups(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _replaced(text: Column, steps) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def strip_python(text: Column) -> Column:
    """Strings, triple-quoted ones first, become empty literals; then comments go."""
    return _replaced(text, ((r'(?s)""".*?"""', '""'), (r"(?s)'''.*?'''", "''"), (r'"[^"\n]*"', '""'), (r"'[^'\n]*'", "''"), (r"#[^\n]*", "")))


def strip_script(text: Column) -> Column:
    """Template literals and strings become empty literals; then block and line comments go."""
    return _replaced(text, ((r"`[^`]*`", "``"), (r'"[^"\n]*"', '""'), (r"'[^'\n]*'", "''"), (r"(?s)/\*.*?\*/", ""), (r"//[^\n]*", "")))


def python_complexity(text: Column) -> Column:
    """Mean over blocks that a def line begins of 1, branches at line starts and half of and/or; a file without def is one block."""
    clean = strip_python(F.coalesce(text, F.lit("")))
    blocks = F.split(clean, r"(?m)^(?=[ \t]*def\s+\w+\s*\()")
    # what comes before the first def is no block, unless there is none
    starts = F.filter(blocks, lambda b: b.rlike(r"^\s*def\s+\w+\s*\("))
    blocks = F.when(F.size(starts) > 0, starts).otherwise(F.array(clean))
    each = F.transform(blocks, lambda b: 1.0 + count(b, r"(?m)^\s*(if|elif|for|while|except|case)\b") + 0.5 * count(b, r"\b(and|or)\b"))
    return F.bround(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(blocks), 2)


def python_imports(text: Column) -> Column:
    """Modules as written, in order; after a from-import also module.member for members whose name begins with a small letter."""

    # two steps, so that a line's module is matched once, however often it is used
    def heads_of(line: Column) -> Column:
        return F.struct(line.alias("line"), F.regexp_extract(line, FROM_IMPORT, 1).alias("module"), F.regexp_extract(line, FROM_IMPORT, 2).alias("names"))

    def of(x: Column) -> Column:
        module, none = x["module"], F.array().cast("array<string>")
        members = F.filter(F.transform(F.split(x["names"], ","), lambda n: F.trim(n)), lambda n: n.rlike(r"^\p{Ll}") & ~F.contains(n, F.lit(".")))
        bare = F.filter(F.transform(F.split(F.regexp_extract(x["line"], BARE_IMPORT, 1), ","), lambda m: F.trim(F.substring_index(F.trim(m), " as ", 1))), lambda m: m != "")
        return F.struct(F.when(module != "", F.array(module)).otherwise(bare).alias("heads"), F.when(module != "", F.transform(members, lambda n: F.concat(module, F.lit("."), n))).otherwise(none).alias("members"))

    split = F.split(F.coalesce(text, F.lit("")), LINE_END)
    lines = F.filter(F.transform(split, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike("^(from|import)"))
    # a member that is there already is not listed again
    return F.aggregate(F.transform(F.transform(lines, heads_of), of), F.array().cast("array<string>"), lambda a, x: F.concat(a, x["heads"], F.array_except(x["members"], F.concat(a, x["heads"]))))


def python_lines(text: Column) -> Column:
    """All lines by any line end, for use as rows; the two signs of one end have an empty line between them, and a last one that is empty is a line."""
    # one sign splits without a pattern, which split would compile for each text
    return F.split(F.translate(F.coalesce(text, F.lit("")), LINE_ENDS, "\n" * len(LINE_ENDS)), "\n")


def script_imports(text: Column) -> Column:
    """Modules of imports and re-exports with from; wildcard re-exports are among them."""
    named, all_ = groups(text, SCRIPT_FROM), groups(text, SCRIPT_ALL)
    return F.concat(named, F.array_except(all_, named))


def python_frameworks(imports: Column) -> Column:
    return F.array_compact(F.transform(imports, lambda x: C.lookup(F.lower(F.substring_index(x, ".", 1)), fixed.PYTHON_FRAMEWORKS)))


def script_frameworks(imports: Column) -> Column:
    def label(x):
        first = F.substring_index(x, "/", 1)
        plain = F.lower(F.regexp_replace(first, "^@+", ""))
        return F.coalesce(C.lookup(plain, fixed.SCRIPT_FRAMEWORKS), F.when(F.startswith(x, F.lit("@")), C.lookup(first, fixed.SCRIPT_FRAMEWORKS)))

    return F.array_compact(F.transform(imports, label))


def _public(names: Column) -> Column:
    return F.filter(names, lambda n: ~F.startswith(n, F.lit("_")))


def _parsed(**parts: Column) -> Column:
    none = F.array().cast("array<string>")
    fields = {"loc": F.lit(0), "imports": none, "framework_signals": none, "function_names": none, "class_names": none, "exports": none, "has_type_annotations": F.lit(False), "has_docstrings": F.lit(False), "has_error_handling": F.lit(False), "sensitive_ops": none, "external_calls": none, "nesting_depth_max": F.lit(0), "complexity_score": F.lit(0.0), "route_methods": none}
    return F.struct(*[v.alias(k) for k, v in (fields | parts).items()])


def parse_python(text: Column) -> Column:
    functions, classes = groups(text, r"(?m)^def\s+(\w+)\s*\("), groups(text, r"(?m)^class\s+(\w+)")
    imports = python_imports(text)
    return _parsed(
        loc=loc(text), imports=imports, framework_signals=python_frameworks(imports), function_names=functions, class_names=classes, exports=F.concat(_public(functions), _public(classes)),
        has_type_annotations=text.rlike(r"def\s+\w+\s*\([^)]*:\s*\w") | text.rlike(r"->\s*\w"), has_docstrings=text.rlike(r'(?s)""".*?"""'), has_error_handling=text.rlike(r"\btry\s*:"),
        sensitive_ops=C.sensitive(text), external_calls=C.external_calls(text), nesting_depth_max=nesting(text), complexity_score=python_complexity(text), route_methods=groups(text, r"""(?i)@\w+\.(get|post|put|delete|patch|route)\s*\(["']([^"']+)["']"""),
    )


def parse_script(text: Column) -> Column:
    named = r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s+)?\()"
    functions = F.filter(F.zip_with(groups(text, named, 1), groups(text, named, 2), lambda a, b: F.when(a != "", a).otherwise(b)), lambda x: x != "")
    imports = script_imports(text)
    branches = count(strip_script(text), r"\b(if|else|for|while|catch)\b|&&|\|\|")
    typed = F.contains(text, F.lit(": ")) & (F.contains(text, F.lit("interface ")) | F.contains(text, F.lit("type ")))
    return _parsed(
        loc=loc(text, "//"), imports=imports, framework_signals=script_frameworks(imports), function_names=functions, exports=groups(text, r"(?m)^export\s+(?:default\s+)?(?:function|class|const|type|interface)\s+(\w+)"),
        has_type_annotations=typed, has_docstrings=text.rlike(r"(?s)/\*\*.*?\*/"), has_error_handling=text.rlike(r"\btry\s*\{"), sensitive_ops=C.sensitive(text), external_calls=C.external_calls(text), complexity_score=(F.size(functions) + branches).cast("double"),
    )


def parse_generic(text: Column) -> Column:
    """Lines that are not blank, and sensitive patterns."""
    return _parsed(loc=loc(text, None), sensitive_ops=C.sensitive(text))


#: The parse of each language; others have the generic one.
PARSERS = {"python": parse_python, "typescript": parse_script, "javascript": parse_script}


def parse(language: Column, text: Column) -> Column:
    """A file's parse by its language."""
    text = F.coalesce(text, F.lit(""))
    chosen = None
    for name, parser in PARSERS.items():
        chosen = F.when(language == name, parser(text)) if chosen is None else chosen.when(language == name, parser(text))
    return chosen.otherwise(parse_generic(text))


def is_entrypoint(role: Column, path: Column, signals: Column) -> Column:
    return (role == "entrypoint") | ((F.size(signals) > 0) & F.lower(C.basename(path)).isin("main.py", "app.py", "server.py", "index.ts", "index.js"))


def is_executable(path: Column, text: Column) -> Column:
    return text.rlike(r"""(?m)^if\s+__name__\s*==\s*["']__main__["']""") | F.startswith(text, F.lit("#!")) | (C.extension(path) == "")

"""Column functions: texts, paths, names and bands. All are built-in expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(key: Column, table: dict, default=None) -> Column:
    """A fixed table as a literal map."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def band(score: Column, bands) -> Column:
    """The label of the first band that holds a score."""
    return F.coalesce(*[F.when(score.between(lo, hi), F.lit(label)) for lo, hi, label in bands])


def tier(value: Column, tiers) -> Column:
    """The points of the first tier whose floor a value reaches."""
    return F.coalesce(*[F.when(value >= floor, F.lit(points)) for floor, points in tiers])


# ---- texts


def lines(text: Column) -> Column:
    """Lines of a text; the empty piece after a last line feed is no line."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def flags(text: Column, patterns) -> Column:
    """Names of the patterns that a text matches, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p[1]), F.lit(p[0])) for p in patterns]))


def sensitive(text: Column) -> Column:
    order = [*fixed.LINE_PATTERNS[:8], *fixed.FLAG_ONLY_PATTERNS, *fixed.LINE_PATTERNS[8:]]
    return flags(text, order)


def external_calls(text: Column) -> Column:
    return flags(text, fixed.EXTERNAL_CALLS)


def truncated(text: Column, limit: int = 150_000) -> Column:
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"))


def elided(text: Column, side: int = 4000) -> Column:
    """First and last characters of a long text."""
    return F.when(F.length(text) <= 2 * side, text).otherwise(F.concat(F.left(text, F.lit(side)), F.lit("\n... [truncated] ...\n"), F.right(text, F.lit(side))))


def file_confidence(errors: Column) -> Column:
    return F.when(errors == 0, 1.0).otherwise(F.greatest(F.lit(0.3), 1.0 - 0.2 * errors))


def query_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\W+"), lambda x: F.length(x) > 2)


def term_matches(query: Column, text: Column) -> Column:
    """Terms of a query that a text contains."""
    return F.filter(query_terms(query), lambda x: F.contains(F.lower(text), x))


def intent(query: Column) -> Column:
    """The first intent one of whose words a query has."""
    q = F.lower(query)
    found = [F.when(q.rlike(rf"\b(?:{'|'.join(words)})\b"), F.lit(name)) for name, words in fixed.INTENTS]
    return F.coalesce(*found, F.lit("general"))


def share_text(x: Column, digits: int) -> Column:
    """A number from 0 to 1 with so many decimals, rounded as its binary fraction is: 0.1625 is 0.163, as that double lies above itself."""
    unit = 10**digits
    down = F.floor(x * unit)

    def beyond(power):  # the sign of what x is above the middle, in whole numbers
        of = F.floor(x * float(1 << power)).cast("long").cast("decimal(19,0)") * F.lit(2 * unit).cast("decimal(6,0)")
        return F.sign(of - (2 * down + 1).cast("decimal(5,0)") * F.lit(str(1 << power)).cast("decimal(22,0)")).cast("int")

    # all bits of x are in so many binary places; smaller numbers than 2**-17 are far from any middle
    off = F.when(x < 2.0**-7, beyond(70)).otherwise(beyond(60))
    near = F.when(off > 0, down + 1).when(off < 0, down).otherwise(down + down % 2)
    return F.format_string(f"%.{digits}f", near / F.lit(float(unit)))


def short_number(n: Column) -> Column:
    """From 1000 on in thousands with one decimal, rounded as the binary fraction n / 1000.0 is: 1950 is 1.9k, as 1.95 lies below itself."""
    n = n.cast("long")
    x, down = n / F.lit(1000.0), F.floor(n / 100)
    scale = F.when(x < 1024, F.lit(float(1 << 52))).otherwise(F.lit(float(1 << 42)))
    wide = lambda c: c.cast("long").cast("decimal(20,0)")
    # the sign of what the fraction is off by, in whole numbers
    off = F.sign(wide(x * scale) * F.lit(1000).cast("decimal(5,0)") - n.cast("decimal(16,0)") * wide(scale)).cast("int")
    half = F.when(off > 0, down + 1).when(off < 0, down).otherwise(down + down % 2)
    tenths = F.when(n % 100 == 50, half).otherwise(F.floor((n + 50) / 100))
    return F.when(n >= 1000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def failure_class(message: Column) -> Column:
    """struct(class, confidence) of the surest rule that matches, the first of equally sure ones; unknown if none does."""
    hits = F.array_compact(F.array(*[F.when(message.rlike(p), F.struct(F.lit(c).alias("confidence"), F.lit(-k).alias("order"), F.lit(n).alias("class"))) for k, (p, n, c) in enumerate(fixed.FAILURE_RULES)]))
    best = F.array_max(hits)
    return F.struct(F.coalesce(best["class"], F.lit("unknown")).alias("class"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"))


def route_params(path: Column) -> Column:
    """Names in {braces} or after colons, in the order of the path."""
    both = lambda g: F.regexp_extract_all(path, F.lit(r"\{(\w+)\}|:(\w+)"), F.lit(g))
    return F.zip_with(both(1), both(2), lambda a, b: F.when(a != "", a).otherwise(b))


# ---- paths


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def basename(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Last suffix of the base name, lower-cased, with its dot; empty for none or a leading dot alone."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def should_skip(path: Column) -> Column:
    return F.arrays_overlap(parts(path), strings(fixed.SKIP_DIRS)) | extension(path).isin(*fixed.SKIP_EXTENSIONS)


def is_generated(path: Column) -> Column:
    name = F.lower(basename(path))
    marked = reduce(lambda a, b: a | b, [F.contains(name, F.lit(m)) for m in fixed.GENERATED_MARKS])
    return marked | F.arrays_overlap(parts(path), strings(fixed.GENERATED_DIRS))


def language(path: Column, content: Column | None = None) -> Column:
    """By extension, then name, then shebang, then content."""
    content = F.coalesce(content, F.lit("")) if content is not None else F.lit("")
    first = F.substring_index(content, "\n", 1)
    shebang = F.coalesce(*[F.when(F.contains(first, F.lit(k)), F.lit(v)) for k, v in fixed.SHEBANGS])
    name = F.lower(basename(path))
    guess = F.when(F.contains(content, F.lit("def ")) & F.contains(content, F.lit("import ")), "python").when((F.contains(content, F.lit("function ")) | F.contains(content, F.lit("const "))) & F.contains(content, F.lit("=>")), "javascript")
    named = F.when(name == "dockerfile", "dockerfile").when(name.isin("makefile", "rakefile", "gemfile"), "unknown")
    return F.coalesce(lookup(extension(path), fixed.LANGUAGE_OF), named, F.when(F.startswith(content, F.lit("#!")), shebang), guess, F.lit("unknown"))


def role(path: Column, frameworks: Column | None = None) -> Column:
    """A file's role: the first test that holds, in this order."""
    name, ps, ext = F.lower(basename(path)), F.transform(parts(path), lambda x: F.lower(x)), F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)
    among = lambda *xs: F.arrays_overlap(ps, strings(xs))
    has = lambda *xs: name.rlike("|".join(xs))
    web = F.coalesce(F.arrays_overlap(frameworks, strings(fixed.WEB_FRAMEWORKS)), F.lit(False)) if frameworks is not None else F.lit(False)
    tests = (
        (among("test", "tests", "spec") | name.rlike(r"^test_|_test\.py$|\.spec\.|\.test\."), "test"),
        (name.isin("dockerfile", "docker-compose.yml", "docker-compose.yaml") | among("infra", "terraform", "k8s", "kubernetes", "deploy", "helm", ".github", ".gitlab"), "infra"),
        (ext.isin(".yml", ".yaml") & has("ci", "workflow", "pipeline", "github", "gitlab"), "infra"),
        (name.isin(*fixed.CONFIG_NAMES), "config"),
        (among("migration", "migrations", "alembic"), "migration"),
        (has("schema", "model", "entity", "type"), "schema"),
        (name.isin(*fixed.ENTRYPOINT_NAMES) | (among("app") & name.isin(*fixed.APP_ROUTER_NAMES)) | (web & name.isin(*fixed.WEB_ENTRY_NAMES)), "entrypoint"),
        (has("service", "manager", "handler", "worker", "processor") | among("services", "handlers", "workers"), "service"),
        (has("route", "router", "api", "endpoint", "view", "controller") | among("api", "routes", "routers", "endpoints", "views", "controllers"), "service"),
        (has("util", "helper", "common", "shared", "mixin") | among("utils", "helpers", "lib", "common", "shared"), "utility"),
        (ext.isin(".py", ".ts", ".js", ".go", ".rs", ".java"), "module"),
    )
    return F.coalesce(*[F.when(test, F.lit(label)) for test, label in tests], F.lit("unknown"))


def service_boundary(path: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(parts(path), lambda x: F.lower(x)), lambda x: x.isin(*fixed.SERVICE_ROOTS)), F.lit(1))


def scan_priority(path: Column, kind: Column, size: Column) -> Column:
    """struct(rank, size step): what is scanned first sorts first."""
    noise = F.when(kind != "blob", 999).when(F.arrays_overlap(parts(path), strings(fixed.SKIP_DIRS)), 998).when(extension(path).isin(*fixed.SKIP_EXTENSIONS), 997)
    step = F.least(F.floor(F.coalesce(size, F.lit(0)) / 10_000), F.lit(5)).cast("int")
    return F.struct(F.coalesce(noise, lookup(role(path), fixed.ROLE_PRIORITY, 10)).alias("rank"), F.when(noise.isNull(), step).otherwise(0).alias("step"))


# ---- names and URLs


def rounded(x: Column, places: int) -> Column:
    """A double to so many places (at most 6) by its exact binary value, halves to even; rounding functions go by the shortest decimal instead."""
    scale = float(10**places)
    # x times the scale is product + lost, exactly: x is split so that neither part's product is rounded
    part = lambda x: 134217729.0 * x - (134217729.0 * x - x)
    one = lambda x: F.struct((x * scale).alias("product"), ((part(x) * scale - x * scale) + (x - part(x)) * scale).alias("lost"), F.floor(x * scale).cast("double").alias("whole"))

    def settle(v: Column) -> Column:
        over = ((v["product"] - v["whole"]) - 0.5) + v["lost"]
        up = (over > 0) | ((over == 0) & (v["whole"] % 2 != 0))
        return (v["whole"] + F.when(up, 1.0).otherwise(0.0)) / scale

    return F.transform(F.array(one(x.cast("double"))), settle)[0]


def exact_repo(query: Column) -> Column:
    """The one repository that a search names, as struct(owner, repo), or null: by address, repo:owner/name, owner/name or "owner name"."""
    clean = F.regexp_replace(F.regexp_replace(query, r"^\s+|\s+$", ""), "^/+|/+$", "")
    clean = F.when(F.lower(clean).startswith("repo:"), F.regexp_replace(F.substr(clean, F.lit(6)), r"^\s+|\s+$", "")).otherwise(clean)
    address = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)"
    hosted = F.lower(F.regexp_extract(clean, address, 1)).isin(*fixed.REPO_HOSTS)
    path = F.filter(F.split(F.regexp_replace(F.regexp_extract(clean, address, 2), ";[^/]*$", ""), "/"), lambda x: x != "")
    pair = lambda p: F.when(clean.rlike(p), F.array(F.regexp_extract(clean, p, 1), F.regexp_extract(clean, p, 2)))
    spoken = F.coalesce(pair(r"^([A-Za-z0-9-]+)/([A-Za-z0-9_.-]+)$"), pair(r"^([A-Za-z0-9-]+)\s+([A-Za-z0-9_.-]+)$"))
    found = F.when(hosted & (F.size(path) >= 2), path).otherwise(spoken)
    owner, repo = F.get(found, F.lit(0)), F.regexp_replace(F.get(found, F.lit(1)), r"\.git$", "")
    valid = owner.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?$") & repo.rlike(r"^[A-Za-z0-9_.-]{1,100}$")
    return F.when(valid, F.struct(owner.alias("owner"), repo.alias("repo")))


def canonical_repo(url: Column) -> Column:
    """struct(owner, name, clone_url, canonical_url) of an address at the known host, with or without its scheme; null for others and for its pages that are no repository."""
    whole = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/+$", "")
    whole = F.when(whole.rlike("^https?://"), whole).otherwise(F.concat(F.lit("https://"), whole))
    owner, name = F.regexp_extract(whole, fixed.REPO_ADDRESS, 1), F.regexp_replace(F.regexp_extract(whole, fixed.REPO_ADDRESS, 2), r"\.git$", "")
    at = F.concat(F.lit(f"https://{fixed.REPO_HOSTS[0]}/"), owner, F.lit("/"), name)
    known = whole.rlike(fixed.REPO_ADDRESS) & ~owner.isin(*fixed.HOST_PAGES) & (name != "")
    return F.when(known, F.struct(owner.alias("owner"), name.alias("name"), F.concat(at, F.lit(".git")).alias("clone_url"), at.alias("canonical_url")))


def https_repo(url: Column) -> Column:
    """struct(owner, repo) of a full https address at the known host, whatever follows the repository; null for others."""
    clean = F.regexp_replace(url, r"^\s+|\s+$", "")
    part = lambda k: F.regexp_extract(clean, fixed.HTTPS_REPO, k)
    return F.when(clean.rlike(fixed.HTTPS_REPO), F.struct(part(1).alias("owner"), part(2).alias("repo")))


def loose_repo(url: Column) -> Column:
    """struct(owner, repo): the first two parts of a path, after the known host if it is there; null for fewer parts."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/+$", "")
    parts = F.split(F.regexp_replace(clean, r"^(?:https?://)?github\.com/", ""), "/")
    return F.when(F.size(parts) >= 2, F.struct(parts[0].alias("owner"), parts[1].alias("repo")))


def repo_of_url(url: Column) -> Column:
    """struct(owner, repo) of a repository address in any of its spellings; nulls if it is none."""
    pattern = r"^(?:https?://|git@|ssh://git@)?(?:www\.)?[A-Za-z0-9.-]+[/:]([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?(?:[?#].*)?$"
    owner, repo = F.regexp_extract(F.trim(url), pattern, 1), F.regexp_extract(F.trim(url), pattern, 2)
    return F.struct(F.nullif(owner, F.lit("")).alias("owner"), F.nullif(repo, F.lit("")).alias("repo"))


def url_label(url: Column) -> Column:
    """Last two segments of a URL."""
    segments = F.split(F.regexp_replace(url, "/+$", ""), "/")
    return F.array_join(F.slice(segments, F.greatest(F.size(segments) - 1, F.lit(1)), 2), "/")

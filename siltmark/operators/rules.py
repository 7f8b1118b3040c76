"""Rules over repository facts: one wide row a repository, each rule an expression that gives a finding or null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C

WEB = ("FastAPI", "Flask", "Django", "Express", "Fastify", "Koa", "NestJS")
#: facts columns: flags has_<x>; languages, frameworks, manifests: arrays; files array<string>; directories array<string>;
#: file_lines array<struct<path, lines>>; sources, tests, routers, total: counts; docker_user: text of Dockerfiles or null;
#: issues array<struct<tool, severity, code, file>>.
FLAGS = ("readme", "license", "ci", "github_actions", "tests", "lockfile", "env_example", "formatter", "linter", "type_checker", "pytest_config", "logging_dependency")


def _f(name: str) -> Column:
    return F.coalesce(F.col(f"has_{name}"), F.lit(False))


def _n(*flags: str) -> Column:
    return sum((_f(x).cast("int") for x in flags), F.lit(0))


def _any_file(pattern: str) -> Column:
    return F.exists("files", lambda p: F.lower(p).rlike(pattern))


def _big(pattern: str, lines: int) -> Column:
    return F.filter("file_lines", lambda x: C.basename(x["path"]).rlike(pattern) & (x["lines"] >= lines))


def _lang(*names: str) -> Column:
    return F.arrays_overlap("languages", C.strings(names))


def _web() -> Column:
    return F.arrays_overlap("frameworks", C.strings(WEB))


def _issues(test) -> Column:
    return F.size(F.filter("issues", test))


def _ratio() -> Column:
    return F.col("tests") / F.greatest(F.col("sources"), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Fires where its test holds. severity may be a column; impact is {domain: points or column}."""

    rule_id: str
    category: str
    severity: str | Column
    impact: dict
    test: Column

    def finding(self) -> Column:
        sev = self.severity if isinstance(self.severity, Column) else F.lit(self.severity)
        pairs = [x for d, p in self.impact.items() for x in (F.lit(d), (p if isinstance(p, Column) else F.lit(p)).cast("int"))]
        return F.when(F.coalesce(self.test, F.lit(False)), F.struct(F.lit(self.rule_id).alias("rule_id"), F.lit(self.category).alias("category"), sev.alias("severity"), F.create_map(*pairs).alias("score_impact")))


def rules() -> list[Rule]:
    """All rules in their order; those that need frameworks fire only where facts have them."""
    m, r, s, t, o, d = "maintainability", "reliability", "security", "testing", "operational_readiness", "developer_experience"
    large = F.size(F.filter("file_lines", lambda x: x["lines"] >= 600))
    py, ruff = _lang("Python"), _issues(lambda x: x["tool"] == "ruff")
    small = F.size(F.filter("file_lines", lambda x: F.contains(F.lower(x["path"]), F.lit("test")) & (x["lines"] < 15))) / F.greatest(F.col("tests"), F.lit(1))
    heavy = lambda x: x["severity"].isin("critical", "high")
    entry = lambda x: C.basename(x["file"]).isin("main.py", "app.py", "server.py", "index.ts", "index.js", "index.tsx")
    bandit_light = _issues(lambda x: (x["tool"] == "bandit") & ~x["severity"].isin("critical", "high"))
    route_like = F.exists("file_lines", lambda x: C.basename(x["path"]).rlike(r"(?i)(router|route|views|endpoints|api)[^/]*\.py$") & (x["lines"] > 100))
    missing = F.lit(3) - _n("tests", "ci", "linter")
    return [
        Rule("HYGIENE-README-001", "hygiene", "medium", {d: -8, m: -4}, ~_f("readme")),
        Rule("HYGIENE-LICENSE-001", "hygiene", "medium", {d: -5}, ~_f("license")),
        Rule("HYGIENE-CI-001", "hygiene", "high", {r: -12, o: -10}, ~_f("ci")),
        Rule("TESTING-001", "testing", "high", {t: -25, r: -8}, ~_f("tests")),
        Rule("DEPS-LOCKFILE-001", "dependencies", "high", {r: -8, s: -5}, (F.size("manifests") > 0) & ~_f("lockfile")),
        Rule("OPS-ENV-001", o, "medium", {o: -10, d: -5}, F.exists("files", lambda p: p.rlike(r"\.env|dotenv|os\.getenv|process\.env")) & ~_f("env_example")),
        # the smaller of both is the larger penalty: the cluster cap hides it, and results keep it
        Rule("HYGIENE-LARGE-FILES-001", "hygiene", "medium", {m: F.least(-4 * large, F.lit(-20))}, large > 0),
        Rule("DX-FORMAT-001", d, "low", {d: -5}, ~_f("formatter")),
        Rule("DX-LINT-001", d, "medium", {d: -7, m: -5}, ~_f("linter")),
        Rule("TEST-CI-001", t, "high", {t: -15, r: -8}, _f("tests") & ~_f("ci")),
        Rule("OPS-HEALTH-001", o, "medium", {o: -8, r: -4}, _web() & ~_any_file("health|healthz|ready|readiness|ping|status") & ((F.col("routers") > 0) | (F.col("sources") >= 5))),
        Rule("TESTING-RATIO-001", t, "medium", {t: -8, r: -4}, _f("tests") & (F.col("sources") >= 5) & (F.col("tests") > 0) & (_ratio() < 0.12)),
        Rule("TESTING-CI-DEPTH-001", t, "medium", {t: -6, r: -3}, _f("tests") & _f("ci") & ~_f("github_actions")),
        Rule("PY-TYPING-001", m, "medium", {m: -8, r: -5}, py & ~_f("type_checker")),
        Rule("PY-TEST-001", t, "high", {t: -20}, py & ~_f("pytest_config") & ~_f("tests")),
        Rule("PY-TYPECFG-001", m, "medium", {m: -7, r: -4}, py & (F.col("sources") >= 8) & ~_f("type_checker")),
        Rule("ARCH-BOUNDARY-001", "architecture", "medium", {m: -8, r: -4}, py & (F.col("routers") == 0) & route_like),
        Rule("ARCH-SERVICE-001", "architecture", "medium", {m: -8, r: -4}, _lang("Python", "TypeScript", "JavaScript") & (F.size("frameworks") > 0) & (F.size(_big(r"^(main|app|server|wsgi|asgi)\.py$|^index\.(ts|js|tsx)$", 300)) > 0) & ~F.exists("directories", lambda x: F.lower(x).rlike("service|business|domain|use_cases|usecases"))),
        Rule("GAMING-FACADE-001", "architecture", "medium", {r: -5, d: -5}, (F.col("total") >= 5) & _f("readme") & _f("license") & (_n("tests", "ci", "type_checker", "linter") < 2)),
        Rule("GAMING-TESTS-001", t, "medium", {t: -10, r: -5}, _f("tests") & (F.col("sources") >= 4) & (F.col("tests") >= 1) & (_ratio() < 0.08) & ((_ratio() < 0.05) | (small >= 0.5))),
        Rule("GAMING-README-001", d, "low", {d: -4}, _f("readme") & (F.col("total") >= 5) & (_n("tests", "ci", "linter", "type_checker", "env_example") < 2) & (missing >= 2)),
        Rule("FASTAPI-ARCH-001", "architecture", "high", {m: -10, r: -4}, F.array_contains("frameworks", "FastAPI") & (F.size(_big(r"^main\.py$", 250)) > 0) & (F.col("routers") < 3)),
        Rule("DOCKER-SEC-001", s, "medium", {s: -8}, F.col("docker_user").isNotNull() & ~(F.contains("docker_user", F.lit("USER")) & ~F.contains("docker_user", F.lit("USER root")))),
        Rule("SEC-DENSITY-001", s, "high", {s: -10, r: -5}, (_issues(heavy) >= 3) & (_issues(lambda x: heavy(x) & entry(x)) >= 2)),
        Rule("PY-LINT-DENSITY-001", m, F.when(ruff >= 100, "high").when(ruff >= 40, "medium").otherwise("low"), {m: -F.least(F.floor(ruff / 10), F.lit(15)), d: -5}, ruff >= 15),
        Rule("SEC-BANDIT-GROUPED-001", s, "medium", {s: -F.least(2 * bandit_light, F.lit(10))}, bandit_light >= 3),
        Rule("PY-TYPING-SIGNAL-001", m, "medium", {m: -6, r: -4}, ~_f("type_checker") & (_issues(lambda x: F.startswith(x["code"], F.lit("ANN"))) >= 5)),
        Rule("OPS-LOGGING-001", o, "low", {o: -5}, py & _web() & ~_f("logging_dependency") & ~_any_file("logging|logger|log_config")),
        Rule("OPS-DEPLOY-001", o, "low", {o: -7}, _web() & (F.col("sources") >= 5) & ~_any_file(r"(^|/)(dockerfile|procfile|fly\.toml|render\.yaml|vercel\.json|app\.yaml|netlify\.toml)$|docker-compose|/k8s/|/helm/")),
    ]


#: Kept for callers that ask for it by name; the default registry leaves it out.
UNREGISTERED = ("OPS-DEPLOY-001",)


def review(facts: DataFrame, key: str = "repo_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Findings of every repository: (key, ordinal, rule_id, category, severity, score_impact), secrets and grave tool issues one each."""
    on = [r for r in rules() if r.rule_id not in UNREGISTERED or r.rule_id in extra]
    rows = facts.select(key, F.posexplode(F.array(*[r.finding() for r in on])).alias("ordinal", "f")).filter("f is not null").select(key, "ordinal", "f.*")
    each = facts.select(key, F.posexplode("issues").alias("ordinal", "i")).filter(((F.col("i.tool") == "bandit") & F.col("i.severity").isin("critical", "high")) | (F.col("i.tool") == "gitleaks"))
    secret = F.col("i.tool") == "gitleaks"
    points = F.when(F.col("i.severity") == "critical", -12).otherwise(-8)
    each = each.select(key, (F.col("ordinal") + 100).alias("ordinal"), F.when(secret, "SEC-SECRETS-001").otherwise("SEC-BANDIT-GROUPED-001").alias("rule_id"), F.lit("security").alias("category"), F.col("i.severity").alias("severity"), F.create_map(F.lit("security"), points).alias("score_impact"))
    return rows.unionByName(each)

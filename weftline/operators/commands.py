"""Predicates on commands, as columns: what shape of command it is, and which forms are never filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

# For each shape the commands themselves, and what a command starts with.
SHAPES: dict[str, tuple[list[str], list[str]]] = {
    "path_listing": (["ls", "ls -R", "dir", "gci", "tree"], ["ls ", "find ", "dir ", "Get-ChildItem", "get-childitem", "gci ", "tree "]),
    "git_log": (["git log"], ["git log "]),
    "git_status": (["git status"], ["git status "]),
    "git_diff": (["git diff"], ["git diff "]),
    "kubectl": (["kubectl", "k"], ["kubectl ", "k "]),
    "package_manager": ([], ["npm ", "yarn ", "pnpm ", "bun ", "cargo ", "pip ", "uv ", "composer ", "gem ", "go ", "gradle ", "maven ", "mvn ", "dotnet "]),
    "terraform": ([], ["terraform "]),
    "docker_compose": ([], ["docker-compose ", "docker compose "]),
    "build": ([], ["make ", "ninja ", "cmake ", "bazel ", "sbt ", "mvn ", "gradle ", "cargo build", "cargo test", "go build", "go test", "dotnet build", "dotnet test"]),
    "cargo_tree": (["cargo tree"], ["cargo tree "]),
    "ps": (["ps"], ["ps "]),
    "grep": (["grep"], ["grep "]),
}
POLLS = ["phase=", "status=", "state="]
VERSION_TOOLS = ["git", "node", "docker", "npm", "npx", "pnpm", "yarn", "bun"]
JOB_TOOLS = ["cargo", "make", "ninja", "cmake", "mvn", "gradle", "build"]


def shapes(command: Column | str) -> Column:
    """Names of the shapes of a command, in the order of SHAPES; `cargo_metadata` stands before `cargo_tree`."""
    c = F.trim(T.text(command))
    out = []
    for name, (whole, heads) in SHAPES.items():
        hit = c.isin(whole) if whole else F.lit(False)
        for h in heads:
            hit = hit | c.startswith(h)
        if name == "grep":
            hit = hit & ~c.startswith("grep -V")
        if name == "cargo_tree":
            out.append(F.when(T.text(command).contains("cargo metadata"), "cargo_metadata"))
        out.append(F.when(hit, name))
    return F.array_compact(F.array(*out))


def output_shapes(output: Column | str) -> Column:
    """Shapes told by the output: `git_log` (a commit line among the first five), `cargo` (its messages among the first 50), `status_poll` (three polls among the first 80)."""
    ls = T.lines(output)
    any_in = lambda n, test: F.exists(F.slice(ls, 1, n), test)

    def cargo(s: Column) -> Column:
        t = F.trim(s)
        return t.startswith("Compiling ") | t.startswith("Finished ") | t.startswith("error[E") | t.contains("test result:")

    def poll(s: Column) -> Column:
        t = F.trim(s)
        return t.startswith(POLLS[0]) | t.startswith(POLLS[1]) | t.startswith(POLLS[2])

    polls = F.size(F.filter(F.slice(ls, 1, 80), poll)) >= 3
    return F.array_compact(F.array(F.when(any_in(5, lambda s: s.startswith("commit ")), "git_log"), F.when(any_in(50, cargo), "cargo"), F.when(polls, "status_poll")))


def _tool(word: Column) -> Column:
    return F.regexp_replace(F.lower(T.basename(word)), r"\.exe$", "")


def bypass(effective: Column | str, tokens: Column) -> Column:
    """Why a command's output is never filtered: help, version (of at most three words), verbose or yaml; `json` if only filters that summarise JSON may; null for others."""
    e = T.text(effective)
    low = F.transform(tokens, F.lower)
    any_of = lambda words: F.arrays_overlap(low, F.array(*[F.lit(w) for w in words]))
    raw = lambda words: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    after = lambda flag, tools: F.exists(F.transform(tokens, lambda t, i: F.when((t == flag) & (i > 0), _tool(F.get(tokens, i - 1)).isin(tools)).otherwise(False)), lambda x: x)
    holds = lambda parts: F.coalesce(*[F.when(e.contains(p), True) for p in parts], F.lit(False))
    helped = raw(["-h", "-help", "/h", "/?"]) | any_of(["--help", "help"]) | F.exists(low, lambda t: t.startswith("--help-") | t.startswith("-help-"))
    version = (any_of(["--version", "version"]) | raw(["-V"]) | after("-v", VERSION_TOOLS)) & (F.size(tokens) <= 3)
    verbose = raw(["-vv", "-vvv"]) | any_of(["--debug", "--verbose", "--trace"]) | F.exists(low, lambda t: t.startswith("--log-level=debug") | t.startswith("--log-level=trace"))
    yaml = any_of(["--yaml", "-o=yaml", "yaml"]) | holds(["-o yaml", "--format yaml", "--format=yaml"])
    jobs = F.exists(F.transform(tokens, lambda t, i: (t == "-j") & ((i == 0) | ~_tool(F.get(tokens, F.greatest(i - 1, F.lit(0)))).isin(JOB_TOOLS))), lambda x: x)
    json = any_of(["--json", "-o=json", "json"]) | jobs | holds(["-o json", "--format json", "--format=json", "--message-format=json", "--message-format json"])
    return F.when(helped, "help").when(version, "version").when(verbose, "verbose").when(yaml, "yaml").when(json, "json")


def uncovered(stats: DataFrame, filters: DataFrame) -> DataFrame:
    """stats (base, waste) with waste that no filter (name, pattern) covers: a filter of that name, whose pattern holds the base, or whose name the base starts with. Filters are few: counted before they are broadcast."""
    few = F.broadcast(filters) if filters.count() <= 10_000 else filters
    covered = (F.col("name") == F.col("base")) | F.col("pattern").contains(F.col("base")) | F.col("base").startswith(F.col("name"))
    return stats.where("waste > 0").join(few, covered, "left_anti")

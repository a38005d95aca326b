"""Symbol tables: search and ranking, kinds, mentions, aliases, the graph from source text, its repair, diffs and what they reach.

Symbols are (id, path, name, kind, start, end, rank). Names match in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import chunks, graph, lines
from weftline.plans.scratch import cut

KEY = ["path", "name", "kind", "start", "end"]


def search(symbols: DataFrame, query: str, limit: int, kind: str | None = None) -> DataFrame:
    """Symbols whose name or path holds the query: equal names first, then by rank, path and line; equal symbols once, before the limit."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.lower("path").contains(q)
    found = symbols.where(hit if kind is None else hit & (F.lower("kind") == kind.lower()))
    once = found.groupBy(*KEY).agg(F.max("rank").alias("rank"))
    return once.withColumn("exact", F.lower("name") == q).orderBy(F.desc("exact"), F.desc("rank"), "path", "start", "name", "kind", "end").limit(limit)


def exact_if_present(found: DataFrame, by: list[str]) -> DataFrame:
    """Of the rows of each `by`, those marked exact, if there are any, else all."""
    return found.withColumn("any", F.max("exact").over(Window.partitionBy(*by))).where(F.col("exact") | ~F.col("any")).drop("any")


def kinds(symbols: DataFrame) -> DataFrame:
    """(kind, n), most frequent first."""
    return symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def of_path(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("start", "name")


def mentioning(texts: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """texts that hold one of a few names anywhere: what must be read again when these change."""
    hit = F.lit(False)
    for n in names:
        hit = hit | F.col(text_col).contains(n)
    return texts.where(hit)


def file_tokens(files: DataFrame, parts: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, tokens) of every file, 0 without parts. The parts are summed before they meet the files."""
    by = parts.groupBy(key).agg(F.sum(tokens).alias("tokens"))
    return files.select(key).join(by, key, "left").select(key, F.coalesce("tokens", F.lit(0)).alias("tokens"))


def file_ranks(symbols: DataFrame, parts: DataFrame, key: str, rank: str) -> DataFrame:
    """(path, rank): the highest rank of a file's symbols; symbols and parts share key, parts have path."""
    return symbols.select(key, F.col(rank).alias("rank")).join(parts.select(key, "path"), key).groupBy("path").agg(F.max("rank").alias("rank"))


def aliases(content: Column | str) -> Column:
    """Map of the short names that a text's import statements make to what they stand for: `use a::b::{c as d, e};`, `use a::b as c;`, `import { a as b } from 'x'`. Later ones win."""
    c = T.text(content)
    group = r"\buse\s+([^;{]+)::\{([^}]+)\}\s*;"
    direct = r"\buse\s+([A-Za-z_][A-Za-z0-9_:]*(?:::[A-Za-z_][A-Za-z0-9_]*)+)(?:\s+as\s+([A-Za-z_][A-Za-z0-9_]*))?\s*;"
    named = r"\bimport\s+\{([^}]+)\}\s+from\s+['\"][^'\"]+['\"]"
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))

    def items(body: Column, prefix: Column) -> Column:
        words = F.transform(F.split(body, ","), lambda s: F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""))
        fit = F.filter(words, lambda w: (F.size(w) == 1) | ((F.size(w) == 3) & (F.get(w, F.lit(1)) == "as")))
        return F.transform(fit, lambda w: pair(F.element_at(w, -1), F.concat(prefix, F.get(w, F.lit(0)))))

    grouped = F.zip_with(F.regexp_extract_all(c, F.lit(group), F.lit(1)), F.regexp_extract_all(c, F.lit(group), F.lit(2)), lambda p, b: items(b, F.concat(F.trim(p), F.lit("::"))))
    single = F.zip_with(F.regexp_extract_all(c, F.lit(direct), F.lit(1)), F.regexp_extract_all(c, F.lit(direct), F.lit(2)), lambda p, a: pair(F.when(a != "", a).otherwise(F.substring_index(p, "::", -1)), p))
    script = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(named), F.lit(1)), lambda b: items(b, F.lit(""))))
    all_ = F.concat(F.flatten(grouped), single, script)
    last = F.aggregate(all_, F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return last


def substituted(refs: DataFrame, alias_map: Column, ref: str = "ref") -> DataFrame:
    """refs with ref replaced by what the map says it stands for."""
    return refs.withColumn(ref, F.coalesce(F.try_element_at(alias_map, F.col(ref)), F.col(ref)))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges (caller, callee) of files (path, text, lang): chunks with a symbol, references without comments and strings, aliases replaced, names resolved."""
    found = chunks.chunks(files, "path", lang=F.col("lang")).where("symbol <> ''")
    symbols = cut(found.select(F.col("chunk_id").alias("id"), F.col("id").alias("path"), F.col("symbol").alias("name"), "kind", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "content"))
    known = files.select("path", aliases("text").alias("__a"))
    refs = symbols.join(known, "path").select(F.col("id").alias("caller"), F.explode(chunks.references("content")).alias("ref"), "__a")
    refs = substituted(refs, F.col("__a")).select("caller", "ref").distinct()
    return symbols, chunks.resolve(refs, symbols.select(F.col("id").alias("callee"), "name", "path"))


def repair(symbols: DataFrame, edges: DataFrame, files: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges after the files (path, text, lang; the present ones) of changed (path) were edited, added or removed; equal to a full build.

    Read again: the changed files, and the files that hold a name which gained or lost a definition in them. Edges of all others stay.
    """
    gone = symbols.join(changed, "path", "left_semi")
    kept = symbols.join(changed, "path", "left_anti")
    fresh, _ = build(files.join(changed, "path", "left_semi"))
    new = cut(kept.unionByName(fresh))
    touched = cut(gone.select("name").union(fresh.select("name")).select(F.lower("name").alias("n")).distinct())
    words = kept.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([a-z_][a-z0-9_]*)"), F.lit(1)))).alias("n"))
    dirty = words.join(touched, "n", "left_semi").select("id").distinct()
    again = cut(dirty.union(fresh.select("id")).distinct())
    stays = edges.join(gone.select(F.col("id").alias("caller")), "caller", "left_anti").join(again.select(F.col("id").alias("caller")), "caller", "left_anti")
    known = files.select("path", aliases("text").alias("__a"))
    refs = new.join(again, "id", "left_semi").join(known, "path").select(F.col("id").alias("caller"), F.explode(chunks.references("content")).alias("ref"), "__a")
    refs = substituted(refs, F.col("__a")).select("caller", "ref").distinct()
    made = chunks.resolve(refs, new.select(F.col("id").alias("callee"), "name", "path"))
    return new, cut(stays.select("caller", "callee").union(made.select("caller", "callee")).distinct())


def diff_ranges(diffs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, path, first, last) of the new side's hunks of unified diffs. A `+++` line names a file only right after a `---` line; deleted files have no range."""
    w = Window.partitionBy("row").orderBy("pos")
    rows = diffs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), lines.numbered(text_col).alias("l")).select("id", "row", F.inline("l"))
    head = F.col("line").startswith("+++ ") & F.lag("line", 1, "").over(w).startswith("--- ")
    path = F.regexp_replace(F.trim(F.substring("line", 5, 1 << 30)), r"^(?:b/)+", "")
    rows = rows.withColumn("file", F.when(head, F.when(path == "/dev/null", "").otherwise(F.replace(path, F.lit("\\"), F.lit("/")))))
    rows = rows.withColumn("file", F.last("file", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spec = F.regexp_extract("line", r"^@@[^+]*\+([0-9]+)(?:,([0-9]+))?(?:\s|$)", 0)
    rows = rows.where(F.col("line").startswith("@@") & (F.col("file") != "") & (spec != ""))
    first = F.regexp_extract("line", r"^@@[^+]*\+([0-9]+)", 1).cast("bigint")
    count = F.regexp_extract("line", r"^@@[^+]*\+[0-9]+,([0-9]+)", 1)
    size = F.when(count == "", F.lit(1)).otherwise(F.expr("try_cast(nullif(regexp_extract(line, '^@@[^+]*\\\\+[0-9]+,([0-9]+)', 1), '') as bigint)"))
    return rows.select("id", F.col("file").alias("path"), F.greatest(first, F.lit(1)).alias("first"), F.when(size == 0, first).otherwise(first + size - 1).alias("last"))


def blast_report(symbols: DataFrame, edges: DataFrame, ranges: DataFrame, depth: int, limit: int) -> dict[str, DataFrame]:
    """What a diff touches and reaches. symbols (id, path, name, start, end), edges (src, dst) of ids, ranges (path, first, last).

    changed: symbols in a range; impacted: what leads to them within `depth` steps, nearest, then most depended on, first, with `truncated` where there are more;
    impacted_files: (path, n) of all of these; without_symbols: changed files in which no symbol is touched. Names in angle brackets are seeds, but not reported.
    """
    touched = cut(graph.overlaps(ranges, symbols))
    back = cut(graph.reach(edges, touched.select(F.col("id").alias("node")).distinct(), max(1, depth), reverse=True).where("distance > 0"))
    told = symbols.where(~F.col("name").startswith("<")).select(F.col("id").alias("node"), "name", "path")
    hit = cut(back.join(told, "node").join(graph.degrees(edges).select("node", "in_degree"), "node", "left"))
    n = hit.count()
    return {
        "changed": touched.where(~F.col("name").startswith("<")).orderBy("path", "start"),
        "impacted": hit.orderBy("distance", F.desc("in_degree"), "name", "node").limit(limit).withColumn("truncated", F.lit(n > limit)),
        "impacted_files": hit.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path"),
        "without_symbols": ranges.select("path").distinct().join(touched.select("path"), "path", "left_anti"),
    }


def imports_of(imports: DataFrame, part: str, reverse: bool = False, transitive: bool = False) -> DataFrame:
    """Imports (path, target, resolved, line) of files whose path holds `part`, or, reversed, of what resolves to such a file; transitive: and of what these lead to.

    Files match by containment, not equality, so each front's names are joined by it; every import once.
    """
    imports = cut(imports)
    here, there = ("resolved", "path") if reverse else ("path", "resolved")
    found = cut(imports.where(F.col(here).contains(part)))
    seen = cut(found.where(F.col(there).isNotNull()).select(F.col(there).alias("f")).distinct())
    front = seen
    while transitive and not front.isEmpty():
        near = imports.select(here).distinct().join(F.broadcast(front) if front.count() <= 10_000 else front, F.expr(f"contains({here}, f)"), "left_semi")
        more = imports.join(near, here, "left_semi")
        new = cut(more.where(F.col(there).isNotNull()).select(F.col(there).alias("f")).distinct().join(seen, "f", "left_anti"))
        found = cut(found.union(more).dropDuplicates(["path", "target", "line"]))
        seen = cut(seen.union(new))
        front = new
    return found


def pack(files: DataFrame, key: str, budget: int, most: int = 24) -> DataFrame:
    """(key, path, tokens) of files (key, path, rank, tokens) that fit a budget of tokens, for each key: of its `most` first by rank, tokens and path, in this order, what doesn't fit is skipped."""
    best = Window.partitionBy(key).orderBy(F.desc("rank"), F.desc("tokens"), "path")
    few = files.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "path", "tokens"))).alias("l"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))
    fits = lambda acc, x: (x["tokens"] > 0) & (acc["used"] + x["tokens"] <= budget)
    step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["tokens"]).cast("bigint").alias("used"), F.concat(acc["kept"], F.array(x["r"])).alias("kept"))).otherwise(acc)
    kept = few.withColumn("kept", F.aggregate("l", zero, step)["kept"])
    return kept.select(key, F.inline(F.filter("l", lambda x: F.array_contains(F.col("kept"), x["r"])))).select(key, "path", "tokens")


def pack_path(path: Column | str, profile: str = "default") -> Column:
    """Whether a path belongs into a pack: no sensitive name, and for the profile `security` one about it, else sources, documents, scripts and the main files."""
    p = F.lower(F.replace(T.text(path), F.lit("\\"), F.lit("/")))
    any_of = lambda how, parts: F.coalesce(*[F.when(getattr(p, how)(x), True) for x in parts], F.lit(False))
    sensitive = any_of("contains", ["/.env", "secret", "credential", "private-key", "/target/", "/.git/"]) | any_of("endswith", [".env", ".pem", ".key", ".p12", ".pfx"])
    if profile == "security":
        return ~sensitive & (any_of("contains", ["security", "auth", "hook", "mcp"]) | any_of("endswith", ["cargo.toml", "deny.toml"]))
    return ~sensitive & (any_of("startswith", ["src/", "docs/", "scripts/"]) | p.isin("readme.md", "agents.md", "cargo.toml"))

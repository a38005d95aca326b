"""Registered queries on symbols, commands, usage and groups; see queries.py. The part table stands in for symbols, the trade graph for calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import chunks, commands, events, graph, rules, symbols, usage
from weftline.plans.inputs import EVENT_LOG, TRADE, USAGE, mapped, oracle, table

QUERIES: dict[str, tuple] = {}
_SYMBOLS = "SELECT p_partkey AS id, concat(p_brand, '/', p_type) AS path, p_name AS name, p_type AS kind, p_size AS start, p_size + 4 AS \"end\", p_retailprice AS rank FROM part"
_ORACLE = f"WITH s AS ({_SYMBOLS})"
E = f"WITH RECURSIVE e AS ({oracle(TRADE)})"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _symbols(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), "p_type").alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("start"), (F.col("p_size") + 4).alias("end"), F.col("p_retailprice").alias("rank"))


_RANKED = """SELECT path, name, kind, start, "end", max(rank) AS rank, lower(name) = 'small ring' AS exact FROM s WHERE (contains(lower(name), 'small ring') OR contains(lower(path), 'small ring')) GROUP BY ALL ORDER BY exact DESC, rank DESC, path, start, name, kind, "end" LIMIT 30"""


@query("symbol_search", f"{_ORACLE} {_RANKED}")
def _(spark, d):
    return symbols.search(_symbols(spark, d), "Small Ring", 30)


@query("symbol_search_kind", f"""{_ORACLE} SELECT path, name, kind, start, "end", max(rank) AS rank, lower(name) = 'ring' AS exact FROM s WHERE (contains(lower(name), 'ring') OR contains(lower(path), 'ring')) AND lower(kind) = 'economy' GROUP BY ALL ORDER BY exact DESC, rank DESC, path, start, name, kind, "end" LIMIT 25""")
def _(spark, d):
    return symbols.search(_symbols(spark, d), "ring", 25, "economy")


_TERMS = ["small ring", "ring", "small"]


@query("symbols_exact_first", f"{_ORACLE}, t AS (SELECT unnest(['small ring', 'ring', 'small']) AS term), h AS (SELECT term, id, lower(name) = term AS exact FROM s JOIN t ON contains(lower(name), term)) SELECT * FROM h QUALIFY exact OR NOT bool_or(exact) OVER (PARTITION BY term)")
def _(spark, d):
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    hits = _symbols(spark, d).join(F.broadcast(terms), F.lower("name").contains(F.col("term"))).select("term", "id", (F.lower("name") == F.col("term")).alias("exact"))
    return symbols.exact_if_present(hits, ["term"])


@query("symbol_kinds", f"{_ORACLE} SELECT kind, count(*) AS n FROM s GROUP BY kind")
def _(spark, d):
    return symbols.kinds(_symbols(spark, d))


@query("symbols_of_path", f"""{_ORACLE} SELECT * FROM s WHERE path = 'Brand#2/ECONOMY'""")
def _(spark, d):
    return symbols.of_path(_symbols(spark, d), "Brand#2/ECONOMY")


@query("mentions", "SELECT doc_id FROM documents WHERE contains(text, 'token') OR contains(text, 'the ') OR contains(text, 'Brand#2')")
def _(spark, d):
    return symbols.mentioning(table(spark, d, "documents"), ["token", "the ", "Brand#2"]).select("doc_id")


@query("file_tokens", "SELECT c_custkey, CAST(coalesce(sum(o_orderkey % 500), 0) AS BIGINT) AS tokens FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark, d):
    parts = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 500).alias("tokens"))
    return symbols.file_tokens(table(spark, d, "customer"), parts, "c_custkey", "tokens")


@query("file_ranks", "SELECT o_orderpriority AS path, max(l_extendedprice) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def _(spark, d):
    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("r"))
    return symbols.file_ranks(nodes, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("path")), "id", "r")


@query("alias_substitution", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'store::' || replace(p_name, ' ', '_') WHEN 1 THEN 'a::b::Item' WHEN 2 THEN 'old' ELSE 'other' END AS ref FROM part")
def _(spark, d):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    text = F.concat(F.lit("use store::{"), name, F.lit(" as x, other_"), name, F.lit("};\nuse a::b::Item as y;\nimport { old as z } from './m';\nfn f() {}"))
    refs = table(spark, d, "part").select("p_partkey", text.alias("content"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z"), F.lit("other")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("ref"))
    return symbols.substituted(refs, symbols.aliases("content")).select("p_partkey", "ref")


def _sources(spark, d, changed: bool = False):
    """A module for each nation: a function that calls two others (and, changed, a third), once more in a comment and a string."""
    n = F.col("n_nationkey")
    call = lambda k: F.concat(F.lit("    fn_"), (k % 25).cast("string"), F.lit("()\n"))
    extra = F.when(F.lit(changed) & (n % 5 == 0), call(n + 11)).otherwise("")
    text = F.concat(F.lit("def fn_"), n.cast("string"), F.lit("():\n"), call(n * 7), call(n + 1), extra, F.lit("    # fn_3()\n    print('fn_4()')\n"))
    return table(spark, d, "nation").select(F.concat(F.lit("src/m"), n.cast("string"), F.lit(".py")).alias("path"), text.alias("text"), F.lit("python").alias("lang"))


def _calls(syms, edges):
    a, b = syms.select(F.col("id").alias("caller"), F.col("name").alias("src")), syms.select(F.col("id").alias("callee"), F.col("name").alias("dst"))
    return edges.join(a, "caller").join(b, "callee").select("src", "dst")


@query("graph_build", "SELECT DISTINCT 'fn_' || n_nationkey AS src, 'fn_' || k AS dst FROM (SELECT n_nationkey, unnest([n_nationkey * 7 % 25, (n_nationkey + 1) % 25]) AS k FROM nation) WHERE k <> n_nationkey")
def _(spark, d):
    return _calls(*symbols.build(_sources(spark, d)))


@query("graph_repair", "SELECT DISTINCT 'fn_' || n_nationkey AS src, 'fn_' || k AS dst FROM (SELECT n_nationkey, unnest([n_nationkey * 7 % 25, (n_nationkey + 1) % 25, CASE WHEN n_nationkey % 5 = 0 THEN (n_nationkey + 11) % 25 END]) AS k FROM nation WHERE n_nationkey <> 24) WHERE k <> n_nationkey AND k <> 24")
def _(spark, d):
    syms, edges = symbols.build(_sources(spark, d))
    now = _sources(spark, d, True).where("path <> 'src/m24.py'")
    changed = table(spark, d, "nation").where("n_nationkey % 5 = 0 or n_nationkey = 24").select(F.concat(F.lit("src/m"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"))
    return _calls(*symbols.repair(syms, edges, now, changed))


@query("import_resolution", "SELECT 'src/m' || n_nationkey || '.py' AS path, kind, CASE WHEN k < 25 THEN 'src/m' || k || '.py' END AS resolved FROM (SELECT n_nationkey, 'import' AS kind, (n_nationkey + 1) % 25 AS k FROM nation UNION ALL SELECT n_nationkey, 'import', n_nationkey + 25 FROM nation)")
def _(spark, d):
    files = _sources(spark, d)
    k = F.col("n_nationkey")
    ls = table(spark, d, "nation").select(F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("lang"), F.posexplode(F.array(F.concat(F.lit("import src.m"), ((k + 1) % 25).cast("string")), F.concat(F.lit("from src.m"), (k + 25).cast("string"), F.lit(" import x")), F.lit("x = 1"))).alias("pos", "line"))
    return chunks.resolve_imports(chunks.imports(ls), files).select("path", "kind", "resolved")


_IMPORTS = "SELECT 'm' || src AS path, 'm' || dst AS target, 'm' || dst AS resolved, dst AS line FROM e"


@query("imports_transitive", f"""{E}, i AS ({_IMPORTS}), r(f) AS (SELECT 'm1' UNION SELECT i.resolved FROM r JOIN i ON contains(i.path, r.f)) SELECT DISTINCT i.path, i.target, i.resolved, i.line FROM i JOIN r ON contains(i.path, r.f)""")
def _(spark, d):
    e = mapped(spark, d, TRADE)
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    return symbols.imports_of(e.select(name("src").alias("path"), name("dst").alias("target"), name("dst").alias("resolved"), F.col("dst").alias("line")), "m1", transitive=True)


@query("diff_ranges", "SELECT o_orderkey AS id, 'src/p' || o_custkey % 7 || '.rs' AS path, CAST(o_orderkey % 50 + 1 AS BIGINT) AS first, CAST(o_orderkey % 50 + 1 + greatest(o_orderkey % 4 - 1, 0) AS BIGINT) AS last FROM orders WHERE o_orderkey % 6 <> 5")
def _(spark, d):
    k = F.col("o_orderkey")
    path = F.when(k % 6 == 5, "/dev/null").otherwise(F.concat(F.lit("b/src/p"), (F.col("o_custkey") % 7).cast("string"), F.lit(".rs")))
    spec = F.concat((k % 50 + 1).cast("string"), F.when(k % 4 == 1, "").otherwise(F.concat(F.lit(","), (k % 4).cast("string"))))
    text = F.concat(F.lit("diff --git a b\n--- a/old\n+++ "), path, F.lit("\n@@ -3,2 +"), spec, F.lit(" @@ fn x\n+++ added, not a header\n-gone\n"))
    return symbols.diff_ranges(table(spark, d, "orders").select(k.alias("id"), text.alias("text")))


_REACHED = f"""{E}, seed AS (SELECT n_nationkey AS s FROM nation WHERE n_nationkey IN (SELECT min(dst) FROM e)), r(node, distance) AS (SELECT s, 0 FROM seed UNION SELECT e.src, distance + 1 FROM r JOIN e ON e.dst = r.node WHERE distance < 2), m AS (SELECT node, min(distance) AS distance FROM r GROUP BY node HAVING min(distance) > 0)"""


def _blast(spark, d):
    e = mapped(spark, d, TRADE)
    e = e.join(F.broadcast(e.agg(F.min("dst").alias("least"))))
    syms = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 10).alias("start"), (F.col("n_nationkey") * 10 + 5).alias("end"))
    seed = e.select("least").distinct().join(syms, F.col("least") == F.col("id"))
    return symbols.blast_report(syms, e.select("src", "dst"), seed.select("path", (F.col("start") + 2).alias("first"), (F.col("start") + 3).alias("last")), 2, 8)


@query("blast_impacted", f"{_REACHED} SELECT m.node, n_name AS name, 'r' || n_regionkey AS path, CAST(m.distance AS BIGINT) AS distance, (SELECT count(*) FROM e WHERE dst = m.node) AS in_degree, (SELECT count(*) FROM m) > 8 AS truncated FROM m JOIN nation ON n_nationkey = m.node ORDER BY distance, in_degree DESC, n_name LIMIT 8")
def _(spark, d):
    return _blast(spark, d)["impacted"].select("node", "name", "path", "distance", "in_degree", "truncated")


@query("blast_files", f"{_REACHED} SELECT 'r' || n_regionkey AS path, count(*) AS n FROM m JOIN nation ON n_nationkey = m.node GROUP BY n_regionkey")
def _(spark, d):
    return _blast(spark, d)["impacted_files"]


@query("graph_neighbourhood", f"{E}, b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e), r(node, distance) AS (SELECT 0, 0 UNION SELECT b.z, distance + 1 FROM r JOIN b ON b.a = r.node WHERE distance < 2), m AS (SELECT node, min(distance) AS distance FROM r GROUP BY node), x AS (SELECT e.src, e.dst, least(p.distance, q.distance) + 1 AS distance FROM e JOIN m p ON e.src = p.node JOIN m q ON e.dst = q.node) SELECT src, dst, CAST(distance AS BIGINT) AS distance FROM x WHERE distance <= 2 ORDER BY distance, src, dst LIMIT 20")
def _(spark, d):
    return graph.neighbourhood(mapped(spark, d, TRADE), spark.range(1).select(F.col("id").cast("int").alias("node")), 2, 20)


@query("module_accounting", f"{E}, l AS (SELECT a.n_regionkey AS f, b.n_regionkey AS t FROM e JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey), x AS (SELECT f AS module, f = t AS same FROM l UNION ALL SELECT t, false FROM l WHERE f <> t) SELECT module, count(*) FILTER (WHERE same) AS internal, count(*) FILTER (WHERE NOT same) AS external, round(count(*) FILTER (WHERE same) / count(*), 6) AS cohesion FROM x GROUP BY module")
def _(spark, d):
    return graph.cohesion(mapped(spark, d, TRADE), table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("module")))


@query("module_links", f"{E} SELECT a.n_regionkey AS module_from, b.n_regionkey AS module_to, count(*) AS n FROM e JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey GROUP BY ALL")
def _(spark, d):
    return graph.modularity_links(mapped(spark, d, TRADE), table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("module")))


_FILES = "SELECT source AS key, lang || '/' || doc_id AS path, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, (doc_id * 37) % 101 AS rank FROM documents"


@query("greedy_pack", f"""WITH RECURSIVE f AS ({_FILES}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank DESC, tokens DESC, path) AS r FROM f QUALIFY r <= 24),
    w(key, r, used, path, tokens, took) AS (SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, '', 0::BIGINT, false FROM o UNION ALL SELECT o.key, o.r, CASE WHEN o.tokens > 0 AND w.used + o.tokens <= 3000 THEN w.used + o.tokens ELSE w.used END, o.path, o.tokens, o.tokens > 0 AND w.used + o.tokens <= 3000 FROM w JOIN o ON o.key IS NOT DISTINCT FROM w.key AND o.r = w.r + 1)
    SELECT key, path, tokens FROM w WHERE took""")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("key"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), T.tokens("text").alias("tokens"), (F.col("doc_id") * 37 % 101).alias("rank"))
    return symbols.pack(rows, "key", 3000)


_PATHS = "SELECT doc_id, (['src/', 'docs/', 'x/', 'SRC/auth/', 'a/.git/', 'scripts\\\\hook/'])[doc_id % 6 + 1] || (['a.rs', '.env', 'README.md', 'my_secret.txt', 'k.pem'])[doc_id % 5 + 1] AS path FROM documents".replace("\\\\", "\\")


@query("pack_paths", f"""WITH p AS ({_PATHS}), l AS (SELECT doc_id, lower(replace(path, chr(92), '/')) AS p FROM p), s AS (SELECT *, NOT (regexp_matches(p, '/\\.env|secret|credential|private-key|/target/|/\\.git/') OR regexp_matches(p, '(\\.env|\\.pem|\\.key|\\.p12|\\.pfx)$')) AS ok FROM l)
    SELECT doc_id, ok AND (regexp_matches(p, '^(src/|docs/|scripts/)') OR p IN ('readme.md', 'agents.md', 'cargo.toml')) AS packed, ok AND (regexp_matches(p, 'security|auth|hook|mcp') OR regexp_matches(p, '(cargo|deny)\\.toml$')) AS security FROM s""")
def _(spark, d):
    k = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/", "docs/", "x/", "SRC/auth/", "a/.git/", "scripts\\hook/")]), (k % 6 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.rs", ".env", "README.md", "my_secret.txt", "k.pem")]), (k % 5 + 1).cast("int"))
    path = F.concat(folder, name)
    return table(spark, d, "documents").select("doc_id", symbols.pack_path(path).alias("packed"), symbols.pack_path(path, "security").alias("security"))


# ---- commands ---------------------------------------------------------------------------------------------------

_COMMANDS = ["git log --oneline", "git status", "git diff HEAD", "kubectl get pods -o yaml", "npm install", "terraform plan", "docker compose up", "make -j 4", "cargo tree", "cargo metadata --json", "ps aux", "grep -V", "ls -R", "tree", "find . -name x", "cargo test -- --help", "node -v", "git --version", "cargo build -vv", "ninja -j 8", "jq -j .", "kubectl get x -o json", "gci", "k get", "go test ./..."]
_CMD_SQL = "SELECT event_id, ([" + ", ".join(f"'{c}'" for c in _COMMANDS) + "])[event_id % 25 + 1] AS c FROM events"
_TELL = [("path_listing", ["ls", "ls -R", "dir", "gci", "tree"], "ls |find |dir |Get-ChildItem|get-childitem|gci |tree "), ("git_log", ["git log"], "git log "), ("git_status", ["git status"], "git status "), ("git_diff", ["git diff"], "git diff "), ("kubectl", ["kubectl", "k"], "kubectl |k "), ("package_manager", [], "npm |yarn |pnpm |bun |cargo |pip |uv |composer |gem |go |gradle |maven |mvn |dotnet "), ("terraform", [], "terraform "), ("docker_compose", [], "docker-compose |docker compose "), ("build", [], "make |ninja |cmake |bazel |sbt |mvn |gradle |cargo build|cargo test|go build|go test|dotnet build|dotnet test"), ("cargo_tree", ["cargo tree"], "cargo tree "), ("ps", ["ps"], "ps ")]
_SHAPE_SQL = ", ".join([f"CASE WHEN c IN ({', '.join(repr(w) for w in [*whole, '?'])}) OR regexp_matches(c, '^({heads})') THEN '{n}' END" for n, whole, heads in _TELL[:9]] + ["CASE WHEN contains(c, 'cargo metadata') THEN 'cargo_metadata' END"] + [f"CASE WHEN c IN ({', '.join(repr(w) for w in whole)}) OR starts_with(c, '{heads}') THEN '{n}' END" for n, whole, heads in _TELL[9:]] + ["CASE WHEN (c = 'grep' OR starts_with(c, 'grep ')) AND NOT starts_with(c, 'grep -V') THEN 'grep' END"])


def _commands(spark, d):
    return table(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(c) for c in _COMMANDS]), (F.col("event_id") % 25 + 1).cast("int")).alias("c"))


@query("command_shapes", f"WITH c AS ({_CMD_SQL}), s AS (SELECT unnest([{_SHAPE_SQL}]) AS shape FROM c) SELECT shape, count(*) AS n FROM s WHERE shape IS NOT NULL GROUP BY shape")
def _(spark, d):
    return _commands(spark, d).select(F.explode(commands.shapes("c")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


@query("command_bypass", f"""WITH c AS ({_CMD_SQL}) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c = 'cargo test -- --help' THEN 'help' WHEN c IN ('node -v', 'git --version', 'grep -V') THEN 'version' WHEN c = 'cargo build -vv' THEN 'verbose'
    WHEN c = 'kubectl get pods -o yaml' THEN 'yaml' WHEN c IN ('cargo metadata --json', 'jq -j .', 'kubectl get x -o json') THEN CASE WHEN c = 'jq -j .' THEN 'json' ELSE 'json' END END AS reason FROM c) GROUP BY reason""")
def _(spark, d):
    return _commands(spark, d).select(commands.bypass("c", F.split("c", " ")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("output_shapes", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'git_log' WHEN turn % 3 = 1 THEN 'cargo' ELSE 'status_poll' END AS shape FROM conversations")
def _(spark, d):
    t = F.col("turn")
    text = F.when(t % 3 == 0, "a\ncommit 1234567\nx").when(t % 3 == 1, "x\n   Compiling y v1\n").otherwise("phase=1\nz\n status=2\nstate=3")
    return table(spark, d, "conversations").select("conv_id", t, F.array_join(commands.output_shapes(text), ",").alias("shape"))


@query("filter_coverage", "WITH s AS (SELECT p_name AS base, CAST(sum(p_size) AS BIGINT) - 100 AS waste FROM part GROUP BY p_name), f(name, pattern) AS (VALUES ('small ring', '^x'), ('big', '^y'), ('zz', '(red bolt|green gear)')) SELECT base, waste FROM s WHERE waste > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE name = base OR contains(pattern, base) OR starts_with(base, name))")
def _(spark, d):
    stats = table(spark, d, "part").groupBy(F.col("p_name").alias("base")).agg((F.sum("p_size") - 100).alias("waste"))
    return commands.uncovered(stats, spark.createDataFrame([("small ring", "^x"), ("big", "^y"), ("zz", "(red bolt|green gear)")], "name string, pattern string"))


# ---- usage and groups -------------------------------------------------------------------------------------------


def _records(spark, d):
    return mapped(spark, d, USAGE)


@query("repeated_outputs_of_last", f"""WITH ev AS ({oracle(EVENT_LOG)}), b AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, event_id) AS no FROM ev WHERE command <> '' AND actual_tokens >= 200),
    p AS (SELECT event_id, no, lag(no) OVER w AS before, lag(event_id) OVER w AS earlier, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS age FROM b WINDOW w AS (PARTITION BY project, command, digest ORDER BY ts, event_id)) SELECT event_id, earlier, age FROM p WHERE age <= 86400 AND no - before <= 24""")
def _(spark, d):
    return events.repeated_outputs(mapped(spark, d, EVENT_LOG), ttl=86_400, entries=24)


@query("event_groups", "WITH g AS (SELECT event_type AS key, count(*) AS n, CAST(sum(event_id % 10) AS BIGINT) AS size, min(event_id) AS f FROM events GROUP BY event_type) SELECT key, n, size, CAST(row_number() OVER (ORDER BY f, key) AS INTEGER) AS place, CAST(row_number() OVER (ORDER BY size DESC, key) AS INTEGER) AS by_size FROM g")
def _(spark, d):
    return events.groups(table(spark, d, "events"), F.col("event_type"), F.col("event_id"), F.col("event_id") % 10)


_EG = """WITH h AS (SELECT DISTINCT page_id AS id, rule, regexp_replace(lower(regexp_extract(url, pat, 1)), '^www\\.', '') AS host FROM pages, (VALUES ('https-url', 'https://(?:[^/@\\s"<>]+@)?([A-Za-z0-9.-]+)'), ('http-url', 'http://(?:[^/@\\s"<>]+@)?([A-Za-z0-9.-]+)')) t(rule, pat) WHERE regexp_matches(url, pat))"""


def _egress(spark, d):
    return rules.egress(table(spark, d, "pages"), "page_id", "url")


@query("egress_groups", f"{_EG}, u AS (SELECT dimension, key, count(*) AS n, min(id) AS f FROM (SELECT 'host' AS dimension, host AS key, id FROM h UNION ALL SELECT 'rule', rule, id FROM h UNION ALL SELECT 'file', CAST(id AS VARCHAR), id FROM h) GROUP BY ALL) SELECT dimension, key, n, CAST(row_number() OVER (PARTITION BY dimension ORDER BY f, key) AS INTEGER) AS place FROM u")
def _(spark, d):
    sides = F.inline(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(c).cast("string").alias("key")) for k, c in (("host", "host"), ("rule", "rule"), ("file", "id"))]))
    by = _egress(spark, d).select("id", sides).groupBy("dimension", "key").agg(F.count("*").alias("n"), F.min("id").alias("f"))
    return by.select("dimension", "key", "n", F.row_number().over(events.Window.partitionBy("dimension").orderBy("f", "key")).alias("place"))


@query("findings_search", f"{_EG} SELECT id, rule, host FROM h WHERE contains(lower(host), 'blog') OR contains(lower(rule), 'blog')")
def _(spark, d):
    return rules.search(_egress(spark, d), "BLOG", ["host", "rule"]).select("id", "rule", "host")


@query("session_audit", """SELECT (SELECT count(*) FROM customer) AS files, (SELECT CAST(sum(c_custkey % 5) AS BIGINT) FROM customer) AS chunks, (SELECT CAST(sum(c_custkey % 100) AS BIGINT) FROM customer) AS tokens, (SELECT count(*) FROM events) AS hook_events,
    (SELECT CAST(sum(s_suppkey % 300) AS BIGINT) FROM supplier) AS prompt_tokens, true AS stale, concat_ws('; ', 'index stale', CASE WHEN (SELECT sum(s_suppkey % 300) FROM supplier) > 10000 THEN 'prompt weight high' END, CASE WHEN (SELECT sum(s_suppkey % 300) FROM supplier) > 6000 THEN 'keep the server list stable' END) AS recommendations""")
def _(spark, d):
    index = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 5).alias("chunks"), (F.col("c_custkey") % 100).alias("tokens"))
    prompt = table(spark, d, "supplier").select((F.col("s_suppkey") % 300).alias("tokens"))
    return events.audit(index, table(spark, d, "events"), prompt, F.lit(True)).withColumn("recommendations", F.array_join("recommendations", "; "))


def register_usage(us: str, ev: str) -> None:
    """Queries whose oracle builds on the usage and event views of queries.py."""
    totals = "SELECT model, round(sum(cost_usd) + 1e-9::DOUBLE, 6) AS cost_usd FROM c GROUP BY model"
    query("usage_places", f"{us}, m AS ({totals}) SELECT model AS key, cost_usd, CAST(row_number() OVER (ORDER BY cost_usd DESC, model) AS INTEGER) AS place FROM m")(lambda spark, d: usage.ranked(usage.rollup(_records(spark, d), "model"), "model").select("key", "cost_usd", "place"))
    query("usage_burn", f"{us}, w AS (SELECT project, CAST(sum(tokens) AS BIGINT) AS tokens, greatest(CAST(floor((epoch(TIMESTAMP '1996-03-17 04:00:00') - epoch(min(ts))) / 60) AS BIGINT), 1) AS minutes FROM c WHERE ts >= TIMESTAMP '1996-03-16 23:00:00' AND ts <= TIMESTAMP '1996-03-17 04:00:00' GROUP BY project) SELECT *, round(tokens / minutes, 6) AS per_minute FROM w")(lambda spark, d: usage.trailing_burn(_records(spark, d), F.lit("1996-03-17 04:00:00").cast("timestamp")))
    query("economics", f"""{us}, m AS (SELECT sum(input) AS i, sum(output) AS o, sum(cache_read) AS r, sum(cache_write) AS w, sum(cost_usd) AS cost FROM c), s AS (SELECT cost, 123456 * cost / (i + 5.0 * o + 1.25 * w + 0.1 * r) AS worth, i + o + r + w AS t FROM m)
        SELECT round(cost, 4) AS spend_usd, round(worth, 6) AS saved_usd, round(least(worth / cost * 100, 100.0), 6) AS pct_of_spend, CAST(t AS BIGINT) AS total_tokens, CAST(123456 AS BIGINT) AS saved_tokens FROM s""")(
        lambda spark, d: usage.economics(usage.with_cost(_records(spark, d)).agg(*[F.sum(m).alias(m) for m in usage.MEASURES[:4]], F.sum("cost_usd").alias("cost_usd")), F.lit(123_456))
    )
    for mode, cost in (("calculate", "(input * i + output * ou + cache_read * r + (cache_write - least(cache_write_1h, cache_write)) * w + least(cache_write_1h, cache_write) * i * 2.0::DOUBLE) / 1e6::DOUBLE"), ("display", "logged_cost")):
        sql = f"{us[: us.rindex('c AS (SELECT')]} c AS (SELECT u.model, coalesce({cost}, 0) AS x FROM u LEFT JOIN tier ON u.model = tier.model AND k = 1) SELECT CASE WHEN grouping(model) = 1 THEN 'TOTAL' ELSE model END AS key, round(sum(x) + 1e-9::DOUBLE, 6) AS cost_usd FROM c GROUP BY ROLLUP (model)"
        query(f"usage_cost_{mode}", sql)(lambda spark, d, mode=mode: usage.rollup(_records(spark, d), "model", mode).select("key", "cost_usd"))
    query("usage_dates", f"{us} SELECT session, CAST(sum(tokens) AS BIGINT) AS tokens FROM c WHERE CAST(ts AS DATE) BETWEEN DATE '1996-01-10' AND DATE '1996-06-30' AND project = 'A' GROUP BY session")(
        lambda spark, d: usage.scoped(usage.with_cost(_records(spark, d)), "1996-01-10", "1996-06-30", "A").groupBy("session").agg(F.sum("tokens").alias("tokens"))
    )

"""Report forms of graph relations: nodes (id, label) and relations (src, dst, reference) to ordered lines, and lines to one text.

Each form is a projection of the distinct nodes and relations, so a diagram of any size is written as lines from many tasks
(`section`, `place`, `line`); `document` joins the lines of a report that the caller has bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import graph


def _node(c: str) -> Column:
    return F.concat(F.lit("N"), F.col(c).cast("string"))


def _quoted(c: Column) -> Column:
    """c in double quotes; backslashes, quotes and line ends escaped."""
    inner = F.replace(F.replace(F.replace(T.text(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def escape_html(c: Column | str) -> Column:
    """Text for HTML or XML; null is empty."""
    out = T.text(c)
    for plain, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def _used(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    ends = relations.select(F.col("src").alias("id")).union(relations.select("dst"))
    return nodes.join(ends.distinct(), "id", "left_semi").dropDuplicates(["id"])


def _lines(head: list[str], parts: list[DataFrame], tail: list[str], spark) -> DataFrame:
    """(section, place, line): head, the parts ordered by their own key, tail."""
    fixed = [(0, f"{i:04d}", s) for i, s in enumerate(head)] + [(len(parts) + 1, f"{i:04d}", s) for i, s in enumerate(tail)]
    out = spark.createDataFrame(fixed, "section int, place string, line string")
    for n, part in enumerate(parts, 1):
        out = out.union(part.select(F.lit(n), "place", "line"))
    return out


def mermaid(nodes: DataFrame, relations: DataFrame, title: str) -> DataFrame:
    """Lines of a left-to-right flowchart; double quotes in labels become single ones."""
    label = F.replace(T.text("label"), F.lit('"'), F.lit("'"))
    boxes = _used(nodes, relations).select(_node("id").alias("place"), F.concat(F.lit("    "), _node("id"), F.lit('["'), label, F.lit('"]')).alias("line"))
    arrow = F.concat(F.lit("    "), _node("src"), F.lit(' -->|"'), F.replace(T.text("reference"), F.lit('"'), F.lit("'")), F.lit('"| '), _node("dst"))
    links = relations.select("src", "dst", "reference").distinct().select(F.concat_ws(" ", _node("src"), _node("dst"), "reference").alias("place"), arrow.alias("line"))
    return _lines(["```mermaid", "graph LR"], [boxes, links], [f"    %% {title}", "```"], nodes.sparkSession)


def dot(nodes: DataFrame, relations: DataFrame, title: str) -> DataFrame:
    """Lines of a directed graph in the DOT language."""
    boxes = _used(nodes, relations).select(_node("id").alias("place"), F.concat(F.lit("  "), _node("id"), F.lit(" [label="), _quoted(F.col("label")), F.lit("];")).alias("line"))
    arrow = F.concat(F.lit("  "), _node("src"), F.lit(" -> "), _node("dst"), F.lit(" [label="), _quoted(F.col("reference")), F.lit("];"))
    links = relations.select("src", "dst", "reference").distinct().select(F.concat_ws(" ", _node("src"), _node("dst"), "reference").alias("place"), arrow.alias("line"))
    quoted = '"' + title.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return _lines(["digraph relations {", f"  label={quoted};", "  rankdir=LR;", "  node [shape=box];"], [boxes, links], ["}"], nodes.sparkSession)


def html(nodes: DataFrame, relations: DataFrame, title: str) -> DataFrame:
    """Lines of a page with one table row a relation."""
    named = relations.select("src", "dst", "reference").distinct()
    for end in ("src", "dst"):
        named = named.join(nodes.dropDuplicates(["id"]).select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    cells = [F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>")) for c in ("src_label", "reference", "dst_label")]
    rows = named.select(F.concat_ws(" ", _node("src"), _node("dst"), "reference").alias("place"), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))
    plain = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return _lines(["<!doctype html>", f"<title>{plain}</title>", "<table>"], [rows], ["</table>"], nodes.sparkSession)


def document(lines: DataFrame) -> DataFrame:
    """(text): the lines in order, each ended. For reports whose size the caller has bounded."""
    rows = F.array_sort(F.collect_list(F.struct("section", "place", "line")))
    return lines.agg(F.concat(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def repository(edges: DataFrame, top: int) -> DataFrame:
    """(heading, place, node, in_degree, out_degree, dependents): the `top` nodes by degree, by fan-in over fan-out, and by transitive dependents.

    The last two lists rank the same candidates, the 3 * top nodes of highest degree. Ties go to the smaller node.
    """
    edges = graph.cut(edges.select("src", "dst"))
    spots = graph.cut(graph.hotspots(edges, 3 * top))  # 3 * top rows
    spots = spots.join(graph.dependents(edges, spots).withColumnRenamed("n", "dependents"), "node", "left").fillna(0, ["dependents"])
    lists = F.array(
        F.struct(F.lit("god nodes").alias("heading"), F.col("degree").alias("by")),
        F.struct(F.lit("bottlenecks").alias("heading"), (F.col("in_degree") - F.col("out_degree")).alias("by")),
        F.struct(F.lit("blast leaders").alias("heading"), F.col("dependents").alias("by")),
    )
    each = spots.select("*", F.inline(lists)).where("heading <> 'bottlenecks' OR by > 0")
    place = F.row_number().over(graph.Window.partitionBy("heading").orderBy(F.desc("by"), "node"))
    return each.withColumn("place", place).where(F.col("place") <= top).select("heading", "place", "node", "in_degree", "out_degree", "dependents")


def module_labels(members: DataFrame) -> DataFrame:
    """(module, label, size) of members (module, path): a file that holds 60 % of them, a nested directory that holds 80 %, else the three largest files."""
    w = graph.Window.partitionBy("module")
    files = members.groupBy("module", "path").agg(F.count("*").alias("n")).withColumn("size", F.sum("n").over(w))
    files = files.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "path"))).withColumn("files", F.count("*").over(w))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", T.basename("path").alias("b"))))), lambda x: x["b"]), " + ")
    by_file = files.groupBy("module").agg(F.max("size").alias("size"), F.max("files").alias("files"), names.alias("joined"), F.max(F.when(F.col("r") == 1, F.struct("n", "path"))).alias("file"))
    dirs = files.groupBy("module", T.directory("path").alias("dir")).agg(F.sum("n").alias("n"))
    by_dir = dirs.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "dir"))).where("r = 1").select("module", "dir", F.col("n").alias("dir_n"))
    more = F.when(F.col("files") > 3, F.concat(F.lit(" +"), (F.col("files") - 3).cast("string"))).otherwise("")
    label = (
        F.when(F.col("file.n") * 10 >= F.col("size") * 6, F.col("file.path"))
        .when(F.col("dir").contains("/") & (F.col("dir_n") * 10 >= F.col("size") * 8), F.concat("dir", F.lit("/")))
        .otherwise(F.concat("joined", more))
    )
    return by_file.join(by_dir, "module").select("module", label.alias("label"), "size")

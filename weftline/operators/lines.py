"""The line model: a text as an array of (pos from 1, line), and the positional operators as functions of that array.

All of them work within the row, so nothing is shuffled, and texts that share an id, or have none, stay apart. `apply` explodes the lines that
are left. Null and empty texts have no lines. Every function is linear in the number of lines, or sorts them once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.text import let

Lines = Callable[[Column], Column]


def numbered(text: Column | str) -> Column:
    """Array of (pos, line)."""
    return F.transform(T.lines(text), lambda s, i: F.struct((i + 1).cast("bigint").alias("pos"), s.alias("line")))


def apply(df: DataFrame, id_col: str, run: Lines | None = None, text_col: str = "text") -> DataFrame:
    """(id, and the fields of what run leaves of the text's lines): pos and line by default."""
    whole = numbered(text_col)
    return df.select(F.col(id_col).alias("id"), (let(whole, run) if run else whole).alias("l")).select("id", F.inline("l"))


def explode_lines(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return apply(df, id_col, None, text_col)


def joined(lines: Column) -> Column:
    """The lines as one text."""
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def _marker(pos: Column, n: Column) -> Column:
    return F.struct(pos.cast("bigint").alias("pos"), F.concat(F.lit("[... "), n.cast("string"), F.lit(" lines omitted ...]")).alias("line"))


def _by_pos(lines: Column) -> Column:
    return F.array_sort(lines)  # pos is the first field


def _range(lines: Column, first: Column, end: Column) -> Column:
    """lines[first:end]. slice() copies the whole array for each part, this only the part."""
    return F.when(end > first, F.transform(F.sequence(first.cast("int"), (end - 1).cast("int")), lambda j: F.get(lines, j))).otherwise(F.slice(lines, 1, 0))


def _from(lines: Column, starts: Column, run: Callable[[Column, Column], Column]) -> Column:
    """The results of run(first line, lines up to the next start), flattened; starts: the lines that open a part, in order."""

    def parts(st: Column) -> Column:
        end = lambda i: F.coalesce(F.get(st, i + 1)["pos"], F.get(lines, F.size(lines) - 1)["pos"] + 1)
        at = F.get(lines, F.lit(0))["pos"]
        return F.flatten(F.transform(st, lambda s, i: run(s, _range(lines, s["pos"] - at, end(i) - at))))

    return let(starts, parts)


def head_tail(head: int, tail: int) -> Lines:
    """First and last lines; of the dropped middle a row with their number at the first dropped place."""

    def run(l: Column) -> Column:  # noqa: E741
        n = F.size(l)
        lost = n - head - tail
        cut = F.concat(F.slice(l, 1, head), F.array(_marker(F.get(l, F.lit(head))["pos"], lost)), F.slice(l, F.greatest(n - tail + 1, F.lit(1)), tail))
        return F.when(lost <= 0, l).otherwise(cut)

    return run


def failure_first(most: int) -> Lines:
    """At most `most` lines of a text: those that tell of a failure first, then from the head; in source order."""

    def run(l: Column) -> Column:  # noqa: E741
        ranked = F.concat(F.filter(l, lambda x: T.is_failure_line(x["line"])), F.filter(l, lambda x: ~T.is_failure_line(x["line"])))
        return F.when(F.size(l) <= most, l).otherwise(_by_pos(F.slice(ranked, 1, most)))

    return run


def category_caps(caps: list[tuple[str, int]]) -> Lines:
    """At most `max` lines of each class; the first pattern that matches owns a line, lines of no class stay."""

    def owner(line: Column) -> Column:
        out = F.lit(-1)
        for i, (pattern, _) in reversed(list(enumerate(caps))):
            out = F.when(line.rlike(pattern), F.lit(i)).otherwise(out)
        return out

    def run(l: Column) -> Column:  # noqa: E741
        owned = F.transform(l, lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), owner(x["line"]).alias("c")))

        def capped(rows: Column) -> Column:
            of = lambda i: F.filter(rows, lambda x: x["c"] == i)
            parts = [of(-1), *(F.slice(of(i), 1, most) for i, (_, most) in enumerate(caps))]
            return F.transform(_by_pos(F.concat(*parts)), lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line")))

        return let(owned, capped)

    return run


def block_caps(start: str, end: str, most: int) -> Lines:
    """First `most` lines of each block that `start` opens and the next `end` line (outside it) closes."""

    def run(l: Column) -> Column:  # noqa: E741
        edges = F.filter(l, lambda x: x["line"].rlike(start) | x["line"].rlike(end))
        before = let(F.get(edges, F.lit(0))["pos"], lambda first: F.when(first.isNull(), l).otherwise(F.slice(l, F.lit(1), (first - 1).cast("int"))))
        return F.concat(before, _from(l, edges, lambda s, part: F.when(s["line"].rlike(start), F.slice(part, 1, most)).otherwise(part)))

    return run


def _changes(l: Column, same: Callable[[Column, Column], Column]) -> Column:  # noqa: E741
    """Lines that differ from the line before."""
    return F.filter(l, lambda x, i: (i == 0) | ~same(F.get(l, i - 1)["line"], x["line"]))


def runs(least: int = 3) -> Lines:
    """(pos, line, n): adjacent equal lines as one row; runs shorter than `least` stay single rows."""
    row = lambda x, n: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), n.cast("bigint").alias("n"))

    def run(l: Column) -> Column:  # noqa: E741
        one = lambda s, part: let(part, lambda p: F.when(F.size(p) >= least, F.array(row(s, F.size(p)))).otherwise(F.transform(p, lambda x: row(x, F.lit(1)))))
        return _from(l, _changes(l, lambda a, b: a == b), one)

    return run


def prefix_runs(least: int = 3, prefix: int = 20) -> Lines:
    """(pos, line, n): adjacent lines that share their first `prefix` characters as one row, for lines at least that long; other lines stay."""
    row = lambda x, n: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), n.cast("bigint").alias("n"))

    def run(l: Column) -> Column:  # noqa: E741
        alike = lambda a, b: (F.char_length(a) >= prefix) & (F.left(a, F.lit(prefix)) == F.left(b, F.lit(prefix)))
        one = lambda s, part: let(part, lambda p: F.when(F.size(p) >= least, F.array(row(s, F.size(p)))).otherwise(F.transform(p, lambda x: row(x, F.lit(1)))))
        return _from(l, _changes(l, alike), one)

    return run


def _fitting(l: Column, budget: Column) -> Column:  # noqa: E741
    """(n, used): how many of the first lines fit a budget of tokens, and the tokens they use."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + T.tokens(x["line"])
        fits = acc["open"] & (used <= budget)
        return F.struct(F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(fits, used).otherwise(acc["used"]).alias("used"), fits.alias("open"))

    return F.aggregate(l, zero, step)


def token_budget(budget: int) -> Lines:
    """Lines that fit the budget: priority lines (errors, first and last quarter) in order until one overflows, then others the same way."""

    def run(l: Column) -> Column:  # noqa: E741
        n = F.size(l)

        def high(x: Column) -> Column:
            t = F.trim(x["line"])
            told = t.startswith("error") | t.startswith("warning") | t.startswith("FAIL") | t.startswith("panic") | t.contains("error[") | t.contains("warning[")
            return told | (x["pos"] <= F.floor(n / 4)) | (x["pos"] > F.floor(n * 3 / 4))

        def fill(first: Column) -> Column:
            rest = lambda got: let(F.filter(l, lambda x: ~high(x)), lambda r: F.concat(F.slice(first, F.lit(1), got["n"]), F.slice(r, F.lit(1), let(F.lit(budget) - got["used"], lambda left: _fitting(r, left)["n"]))))
            return _by_pos(let(_fitting(first, F.lit(budget).cast("bigint")), rest))

        return let(F.filter(l, high), fill)

    return run


def density(fraction: float) -> Lines:
    """Lines of most entropy until the tokens before a line reach this fraction of all, in source order."""

    def run(l: Column) -> Column:  # noqa: E741
        told = F.transform(l, lambda x: F.struct((0.0 - F.round(T.entropy(x["line"]), 9)).alias("bits"), (-F.octet_length(x["line"])).alias("size"), x["pos"].alias("pos"), x["line"].alias("line"), T.tokens(x["line"]).alias("tok")))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"))

        def cut(order: Column) -> Column:
            total = F.aggregate(order, F.lit(0).cast("bigint"), lambda acc, x: acc + x["tok"])
            step = lambda most: lambda acc, x: F.when(acc["used"] < most, F.struct((acc["n"] + 1).alias("n"), (acc["used"] + x["tok"]).alias("used"))).otherwise(acc)
            n = let(F.floor(total * fraction), lambda most: F.aggregate(order, zero, step(most))["n"])
            return F.transform(_by_pos(F.slice(order, F.lit(1), n)), lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line")))

        return let(F.array_sort(told), cut)

    return run


def similar_blocks(threshold: float = 0.8, least: int = 2) -> Lines:
    """(block, n_lines, agreement, similar): blocks between blank lines, and the share of lines equal to the block before, of equal length."""
    blank = lambda x: F.trim(x["line"]) == ""

    def run(l: Column) -> Column:  # noqa: E741
        opens = F.filter(l, lambda x, i: ~blank(x) & ((i == 0) | blank(F.get(l, i - 1))))
        bodies = _from(l, opens, lambda s, part: F.array(F.transform(F.filter(part, lambda x: ~blank(x)), lambda x: x["line"])))

        def told(all_: Column) -> Column:
            def one(b: Column, i: Column) -> Column:
                prior = F.when(i > 0, F.get(all_, i - 1))
                same = F.size(F.filter(F.zip_with(b, prior, lambda x, y: x == y), lambda x: x)) / F.size(b)
                agreement = F.when(F.size(b) == F.size(prior), same).otherwise(F.lit(0.0))
                return let(agreement, lambda a: F.struct(i.alias("block"), F.size(b).alias("n_lines"), a.alias("agreement"), ((a >= threshold) & (F.size(b) >= least)).alias("similar")))

            return F.transform(all_, one)

        return let(bodies, told)

    return run


def retrieve(first: int | None = None, last: int | None = None, grep: str | None = None, head: int | None = None, tail: int | None = None) -> Lines:
    """A window of each text: the lines first to last, of these what matches grep, of these head and tail.

    grep ignores case unless it holds an upper-case letter. With a range or grep, lines carry their number. Between head and tail a row tells how many lines are missing.
    """
    if (first or 1) < 1 or (last is not None and last < (first or 1)):
        raise ValueError("lines count from 1, first <= last")

    def run(l: Column) -> Column:  # noqa: E741
        kept = l
        if first is not None or last is not None:
            kept = F.filter(kept, lambda x: x["pos"].between(first or 1, last if last is not None else 2**62))
        if grep is not None:
            kept = F.filter(kept, lambda x: x["line"].rlike(grep if any(c.isupper() for c in grep) else f"(?i){grep}"))
        if first is not None or last is not None or grep is not None:
            kept = F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), F.concat(x["pos"].cast("string"), F.lit(":"), x["line"]).alias("line")))
        if head is not None and tail is not None:
            return let(kept, head_tail(head, tail))
        if head is not None:
            return F.slice(kept, 1, head)
        return kept if tail is None else let(kept, lambda k: F.slice(k, F.greatest(F.size(k) - tail + 1, F.lit(1)), tail))

    return run


def uncovered(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """(id, start, end): the lines from 1 to the text's total (id, total) that no span (id, start, end) covers, as maximal ranges."""
    edge = totals.select("id", (F.col("total") + 1).alias("start"), (F.col("total") + 1).alias("end"), F.col("total"))
    all_ = spans.select("id", "start", "end", F.lit(None).cast("bigint").alias("total")).join(totals.select("id"), "id", "left_semi").union(edge)
    before = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    total = F.max("total").over(Window.partitionBy("id"))
    gaps = all_.select("id", (F.coalesce(F.max("end").over(before), F.lit(0)) + 1).alias("s"), (F.least(F.col("start") - 1, total)).alias("e"))
    return gaps.where("s <= e").select("id", F.col("s").cast("bigint").alias("start"), F.col("e").cast("bigint").alias("end"))

"""Chat formatting with budgeted windows, in DataFrame operations alone.

A turn is written ``### role: text</turn>`` and a newline. Inside roles and texts ``\\`` becomes ``\\\\``, ``<`` becomes
``\\l``, ``#`` becomes ``\\h`` and (roles only) ``:`` becomes ``\\c``, so no control string can occur in them, and reading
back is exact.

Windows: the prefix sums of turn costs place each turn in the window where its first token falls, so spans always begin and
end between turns. A turn's cost is its tokens: the column ``tokens`` of the turns if the caller has counted them (by any
encoder; frame tokens included), else an estimate, a quarter of the UTF-8 bytes plus four. A window holds the system turn
(if the first row of the conversation has that role), then history - the turns of the window before that begin in the last
``history`` tokens before this window's first turn - and then its own turns. Windows are as far apart as the room that system
turn and history leave, less the dearest turn of the conversation: so a window stays within ``budget`` if each turn fits
that room, and is full but for one turn. A turn that does not fit is never cut; its conversation has windows of half the
room, and the one with that turn is over the budget. Where the system turn and history alone fill the budget, each turn has
a window of its own.

The loss mask covers assistant texts, as [start, end) code points of the window's text; repeated turns are masked out,
so each target counts once.

Defined cases: null roles and texts count as empty; turns with equal numbers (null first) are ordered by role, then
text; a null conv_id is a conversation of its own; an empty table gives an empty table; other columns are not read.
A conversation's rows meet in one sorted, spillable window partition, but no row collects more than one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
_END = "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescape(c: Column) -> Column:
    # What stands between two doubled backslashes holds only single ones, each the start of one escape.
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def turn_cost(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4) + 4


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, cost=turn_cost, tokens: str | None = None) -> DataFrame:
    """Rows (conv_id, window, text, loss: array of (start, end), first_new: index of the first turn not repeated, cost)."""
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.asc_nulls_first("turn"), "role", "text")
    text = F.coalesce("text", F.lit(""))
    spent = cost(text) if tokens is None else F.coalesce(F.col(tokens), cost(text))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), spent.cast("long").alias("cost"))
    rows = rows.withColumn("n", F.row_number().over(order))
    # The order of rows is settled: n stands for it from here on, and the partitioning is never changed again.
    by_n = conv.orderBy("n")
    before = by_n.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    rows = rows.withColumns(
        {
            "start": F.coalesce(F.sum(F.when(F.col("system"), 0).otherwise(F.col("cost"))).over(before), F.lit(0)),
            "system_cost": F.coalesce(F.first(F.when(F.col("system"), F.col("cost"))).over(by_n.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
        }
    )
    room = F.lit(budget) - F.col("system_cost") - history
    rows = rows.withColumn("dearest", F.coalesce(F.max(F.when(~F.col("system"), F.col("cost"))).over(conv), F.lit(0)))
    span = F.greatest(F.lit(1), F.when(F.col("dearest") < room, room - F.col("dearest") + 1).otherwise(F.floor(room / 2)))
    rows = rows.withColumn("window", F.when(F.col("system"), F.lit(0)).otherwise(F.floor(F.col("start") / span)).cast("long"))
    # Numbers without a turn are left out: windows count up one by one.
    rows = rows.withColumn("opens", F.coalesce(F.lag("window").over(by_n) != F.col("window"), F.lit(True)))
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("long")).over(by_n.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    after = conv.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "next_start": F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(after),
            "last_window": F.max("window").over(conv),
        }
    )
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("again")))
    again = F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("again"))
    repeats = ~F.col("system") & (F.col("start") >= F.col("next_start") - history)
    every = F.transform(F.sequence(F.lit(1).cast("long"), F.col("last_window")), lambda w: F.struct(w.alias("window"), F.lit(True).alias("again")))
    copies = (
        F.when(F.col("system") & (F.col("last_window") > 0), F.concat(own, every)).when(repeats, F.concat(own, F.array(again))).otherwise(own)
    )
    rows = rows.withColumn("copy", F.explode(copies))
    rows = rows.select("conv_id", F.col("copy.window").alias("window"), F.col("copy.again").alias("again"), "n", "role", "text", "cost")
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))})
    piece = F.concat("head", "body", F.lit(_END))
    at = Window.partitionBy("conv_id", "window").orderBy("n")
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length(piece)).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begin = F.col("at") + F.length("head")
    target = (F.col("role") == "assistant") & ~F.col("again")
    rows = rows.withColumn("loss", F.when(target, F.struct(begin.alias("start"), (begin + F.length("body")).alias("end"))))
    out = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("n", piece.alias("piece"), "loss"))).alias("all"), F.sum(F.col("again").cast("int")).alias("first_new"), F.sum("cost").alias("cost")
    )
    return out.select(
        "conv_id",
        "window",
        F.array_join(F.col("all.piece"), "").alias("text"),
        F.filter(F.col("all.loss"), lambda x: x.isNotNull()).alias("loss"),
        "first_new",
        "cost",
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Read back: (conv_id, window, turns: array of (role, text) not repeated, targets: texts under the mask, n_chars)."""
    pieces = F.split("text", F.lit("</turn>\n"))
    pieces = F.slice(pieces, F.col("first_new") + 1, F.greatest(F.lit(0), F.size(pieces) - 1 - F.col("first_new")))
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(5)), ": ", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, F.lit(": ")) + 2)).alias("text"),
    )
    target = lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return windows.select(
        "conv_id", "window", F.transform(pieces, turn).alias("turns"), F.transform("loss", target).alias("targets"), F.length("text").alias("n_chars")
    )

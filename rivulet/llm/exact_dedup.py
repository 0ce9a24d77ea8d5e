"""Exact dedup by content sort, in DataFrame operations alone.

Texts are range-partitioned by sampled splitters on (first bytes, hash, salt) and sorted outside memory by
(first bytes, hash, salt, whole text, id). Equal texts are then neighbours, and the window operator, which compares
each row's whole text with its neighbour's to find where a group ends, gives every group its id to keep and size.

A text whose copies are more than ``hot_rows`` or ``HOT_BYTES`` together is dealt row by row over several salts. The heads of
its runs, one row for each salt, are compared (whole texts again) in a second, small aggregation, which chooses the run
whose first row stays. A run grows with the root of the number of copies at most, and so does the number of runs.

Defined cases: a null text counts as the empty text; a null id sorts below every other id when the largest is kept and
above when the smallest is; among fully equal rows exactly one is kept; an empty table gives an empty table; other
columns never clash, because they travel inside one struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialize

#: Rows and bytes of one text in one sorted run; texts that have more are salted.
HOT_ROWS, HOT_BYTES = 256, 16 << 20
#: Bytes of text used, beside its hash, as the range-partitioning key: bounds what the splitter sample holds.
PREFIX = 24


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    normalise: Callable[[Column], Column] | None = None,
    hot_rows: int = HOT_ROWS,
    carry: bool = False,
) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256 (and ``row``, if ``carry``)."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rest = [F.col(c) for c in docs.columns if normalise or c != text_col]
    row = F.struct(F.col(text_col).isNull().alias("no_text"), F.struct(*rest).alias("rest")) if carry else F.lit(None).cast("int")
    # The place of a row in the input deals copies out: ids may be null or equal.
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"), row.alias("row"), F.monotonically_increasing_id().alias("at"))
    base = base.withColumn("h", F.xxhash64("t"))

    sizes = base.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("bytes"))
    salts = F.ceil(F.greatest(F.col("n") / F.greatest(F.lit(hot_rows), F.sqrt("n")), F.least(F.col("bytes") / HOT_BYTES, "n")))
    hot = materialize(sizes.where((F.col("n") > hot_rows) | (F.col("bytes") > HOT_BYTES)).select("h", salts.alias("salts")), "hot-texts")
    salted = base.join(hot, "h", "left").withColumns(
        {
            "p": F.substring(F.encode("t", "utf-8"), 1, PREFIX),
            "s": F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod("at", "salts")),
        }
    )
    order = F.desc_nulls_last("id") if keep == "largest" else F.asc_nulls_last("id")
    run = Window.partitionBy("p", "h", "s", "t").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = salted.repartitionByRange("p", "h", "s").select(
        "id",
        "h",
        "s",
        "row",
        F.first("id").over(whole).alias("run_id"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
        F.row_number().over(run).alias("n"),
        F.sha2("t", 256).alias("text_sha256"),
        F.col("salts").isNotNull().alias("is_hot"),
        F.col("t"),
    )
    head = F.col("is_hot") & (F.col("n") == 1)
    runs = runs.withColumn("t", F.when((F.col("n") == 1) if carry else head, F.col("t")))
    runs = materialize(runs, "text-runs")

    heads = runs.where(head).select("h", "s", "t", "text_sha256", "run_id", "run_size")
    # Nulls last in either order; among equal ids one run.
    best = F.max(F.struct(F.col("run_id").isNotNull(), "run_id", "s")) if keep == "largest" else F.min(F.struct(F.col("run_id").isNull(), "run_id", "s"))
    best = heads.groupBy("h", "t").agg(best.alias("best"), F.sum("run_size").alias("all_size"))
    totals = materialize(heads.join(best, ["h", "t"]).select("h", "s", "text_sha256", "best.run_id", F.col("best.s").alias("best_s"), "all_size"), "hot-totals")
    totals = totals.withColumnRenamed("run_id", "all_id")
    out = (runs if carry else runs.drop("t")).join(totals, ["h", "s", "text_sha256"], "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("run_id")).otherwise(F.col("all_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        ((F.col("n") == 1) & (F.col("best_s").isNull() | (F.col("best_s") == F.col("s")))).alias("kept"),
        "text_sha256",
        *(["row", "t"] if carry else []),
    )


def exact_dedup(docs: DataFrame, text_col: str = "text", normalise: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """The documents that stay, with all their columns; options as in :func:`exact_groups`."""
    kept = exact_groups(docs, text_col=text_col, normalise=normalise, carry=True, **options).where("kept")
    text = F.when(~F.col("row.no_text"), F.col("t"))
    return kept.select(*(text.alias(c) if c == text_col and not normalise else F.col(f"row.rest.`{c}`") for c in docs.columns))

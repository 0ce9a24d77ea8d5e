"""URL filter: host and path rules first, a character language-model ratio for the rest. DataFrame operations alone.

The method: two smoothed variable-order Markov models over the bytes of URLs, one of the accepted and one of the
rejected. A context has up to ``ORDER`` bytes, and is as long as the training URLs bear: each n-gram in them is kept,
however rare. Orders are interpolated by Witten-Bell weights, so each model is a distribution, and a context that was
not seen hands all its weight to the next shorter one. A URL's score is the mean over its bytes of log P(accepted) -
log P(rejected), each rounded to 12 decimals so that the order of adding does not matter; it is accepted if the score
reaches a threshold, calibrated on a held-out fifth of the labelled URLs.

Sizes: n-grams are counted over all labelled URLs. Those of up to ``SHORT`` bytes, of which the alphabet allows
257 x 256 at most, are broadcast; longer ones meet by shuffle, where the alphabet bounds the rows of a key too. Each
distinct window of ``ORDER`` + 1 bytes is looked up once. Windows that are one in ``ENTRIES`` of all or more, of which
there are ``ENTRIES`` at most, reach the URLs by broadcast, the rest by shuffle. Scores are computed once for each
distinct URL. URLs that are one row in ``COMMON`` or more, of which there are ``COMMON`` at most, get theirs by
broadcast, so a URL on a third of all rows gathers in no task. A URL's bytes travel with a number, not with the URL, so
a long one costs its length and not its square.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule, and is scored as its text
(null: empty, score 0); with no labelled URLs at all the models are uniform and the threshold is 0; of equal best
thresholds the lowest is taken; an empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialize

SYMBOLS = 256
#: Longest context; windows broadcast; bytes of the n-grams broadcast.
ORDER, ENTRIES, SHORT = 4, 1 << 16, 2
#: Stands before a URL; no byte, as those are the characters below U+0100.
_START = "\u0100"
#: One URL in so many of the labelled ones calibrates the threshold; the others train the models.
HELD_OUT = 5
COMMON = 1000
#: Bytes of URLs that one task scores.
TASK_BYTES = 8 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], want: int) -> Column:
    """The fitting rule's text (``want`` 0) or verdict (1); rules are (verdict, host, path), and the longest wins."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit((h + p, verdict)[want])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each byte of ``url``: the string ``g`` of the ``ORDER`` bytes before it and itself, a character each."""
    plain = F.decode(F.encode(F.coalesce("url", F.lit("")), "UTF-8"), "ISO-8859-1")
    chars = F.filter(F.split(plain, ""), lambda x: x != "")
    shifted = [F.concat(F.array(*[F.lit(_START)] * k), chars) if k else chars for k in range(ORDER, -1, -1)]
    whole = F.filter(F.arrays_zip(*shifted), lambda g: g[str(ORDER)].isNotNull())
    return df.select(*keep, F.explode(whole).alias("g")).select(*keep, F.concat(*(F.col(f"g.{k}") for k in range(ORDER + 1))).alias("g"))


def _last(n: int) -> Column:
    return F.substring("g", ORDER + 2 - n, n)


def _sided(df: DataFrame, length: int) -> DataFrame:
    """A side of a join by strings of ``length`` bytes: broadcast where the alphabet bounds it, else sorted."""
    return F.broadcast(df) if length <= SHORT else df.hint("merge")


def _models(train: DataFrame, entries: int | None = None) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """Log ratios from labelled URLs (``url``, ``good`` 1 or 0): of n-grams (``key``, ``ratio``), by the length of
    their context, and of the weights that contexts (``key``, ``weight``) leave to shorter ones, by length. With
    ``entries``, n-grams of more than a byte are pruned to those that are one in so many of all."""
    full = _grams(train, "good").groupBy("g").agg(F.sum("good").alias("n1"), F.sum(1 - F.col("good")).alias("n0"))
    full = materialize(full, "url-grams")
    seen = full.agg(F.sum("n1"), F.sum("n0")).first()
    total = {1: seen[0] or 0, 0: seen[1] or 0}
    keys = full.select(F.explode(F.array(*(_last(n) for n in range(1, ORDER + 2)))).alias("key"), "n1", "n0")
    kept = keys.groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    if entries is not None:
        kept = kept.where((F.length("key") == 1) | ((F.col("n1") + F.col("n0")) * entries >= sum(total.values())))
    kept = materialize(kept, "url-kept")

    every = train.sparkSession.createDataFrame([(chr(x),) for x in range(SYMBOLS)], "key string")
    now = every.join(F.broadcast(kept.where("length(key) = 1")), "key", "left")
    for k in (1, 0):
        now = now.withColumn(f"p{k}", (F.coalesce(f"n{k}", F.lit(0)) + 1) / F.lit(total[k] + SYMBOLS))
    now = materialize(now.select("key", "p1", "p0"), "url-order-0")
    grams, contexts = {0: now}, {}
    for order in range(1, ORDER + 1):
        own = kept.where(F.length("key") == order + 1).withColumns({"ctx": F.substring("key", 1, order), "short": F.substring("key", 2, order)})
        sums = [x for k in (1, 0) for x in (F.sum(f"n{k}").alias(f"m{k}"), F.count(F.when(F.col(f"n{k}") > 0, 1)).alias(f"t{k}"))]
        ctx = materialize(own.groupBy("ctx").agg(*sums), "url-contexts")
        below = now.select(F.col("key").alias("short"), F.col("p1").alias("l1"), F.col("p0").alias("l0"))
        now = own.join(_sided(ctx, order), "ctx").join(_sided(below, order), "short")
        for k in (1, 0):
            now = now.withColumn(f"p{k}", _smooth(k))
        now = grams[order] = materialize(now.select("key", "p1", "p0"), f"url-order-{order}")
        contexts[order] = ctx.select(F.col("ctx").alias("key"), (F.log(_left(1)) - F.log(_left(0))).alias("weight"))
    return {k: g.select("key", (F.log("p1") - F.log("p0")).alias("ratio")) for k, g in grams.items()}, contexts


def _smooth(k: int) -> Column:
    """Witten-Bell: n of the gram, m of its context, t different bytes after the context, l of the shorter gram."""
    n, m, t, lower = (F.col(f"{x}{k}") for x in "nmtl")
    return F.when(m > 0, (n + t * lower) / (m + t)).otherwise(lower)


def _left(k: int) -> Column:
    """The weight that a context leaves to the shorter one."""
    m, t = F.col(f"m{k}"), F.col(f"t{k}")
    return F.when(m > 0, t / (m + t)).otherwise(F.lit(1.0))


def url_scores(urls: DataFrame, labelled: DataFrame, entries: int | None = None, hot: int = ENTRIES) -> DataFrame:
    """(url, score) for each distinct non-null url of ``urls`` that is not empty, by models of ``labelled`` (url, good).

    ``entries`` prunes the models; ``hot`` is where windows are broadcast, which changes no score.
    """
    grams, contexts = _models(labelled, entries)
    # Dealt out by size: a row of a URL becomes one for each byte, so partitions of the usual bytes would be few.
    size = urls.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    tasks = max(urls.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    named = urls.select("url").where("url is not null").distinct().withColumn("id", F.monotonically_increasing_id())
    named = materialize(named, "url-named")
    at = _grams(named.repartition(tasks, "id"), "id")
    windows = materialize(at.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "url-windows")
    ratio, each = None, windows
    for k in range(ORDER + 1):
        found = grams[k].select("key", F.col("ratio").alias(f"r{k}"))
        each = each.withColumn("key", _last(k + 1)).join(_sided(found, k + 1), "key", "left").drop("key")
        if k:
            weight = contexts[k].select("key", F.col("weight").alias(f"w{k}"))
            each = each.withColumn("key", F.substring("g", ORDER + 1 - k, k)).join(_sided(weight, k), "key", "left").drop("key")
            ratio = F.coalesce(f"r{k}", F.coalesce(f"w{k}", F.lit(0.0)) + ratio)
        else:
            ratio = F.col("r0")
    each = materialize(each.select("g", "n", ratio.cast("decimal(18,12)").alias("ratio")), "url-ratios")
    often = F.col("n") * hot >= (each.agg(F.sum("n")).first()[0] or 0)
    common, rare = each.where(often).select("g", "ratio"), each.where(~often).select("g", "ratio")
    met = at.join(F.broadcast(common), "g").select("id", "ratio")
    rest = at.join(F.broadcast(common.select("g")), "g", "left_anti").join(rare.hint("merge"), "g").select("id", "ratio")
    scored = met.union(rest).groupBy("id").agg((F.sum("ratio").cast("double") / F.count(F.lit(1))).alias("score"))
    return named.join(scored, "id").select("url", "score")


def calibrated_threshold(scores: DataFrame) -> float:
    """From (score, good): the cut, in hundredths, with the best mean of both classes' hit rates; 0 if a class is missing.

    Scores lie within +-log(256 + bytes learned from), so there are a few thousand hundredths at most.
    """
    steps = scores.groupBy(F.floor(F.col("score") * 100).cast("long").alias("x")).agg(
        F.sum("good").alias("n1"), F.sum(1 - F.col("good")).alias("n0")
    )
    below = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = (F.sum("n1").over(whole) - F.coalesce(F.sum("n1").over(below), F.lit(0))) / F.sum("n1").over(whole)
    rate = rate + F.coalesce(F.sum("n0").over(below), F.lit(0)) / F.sum("n0").over(whole)
    both = (F.sum("n1").over(whole) > 0) & (F.sum("n0").over(whole) > 0)
    best = steps.select("x", F.when(both, rate).alias("rate")).where("rate is not null").orderBy(F.desc("rate"), "x").first()
    return best["x"] / 100 if best else 0.0


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` as struct ``page`` with url, host, path, rule (null: none fits), score (null: a rule fits) and verdict.

    The URLs that a rule decides are the labelled ones. Repeated rows stay repeated.
    """
    url = F.col("url")
    judged = pages.select(F.struct("*").alias("page"), F.col(url_col).alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    host, path = F.col("host"), F.col("path")
    judged = judged.withColumns({"rule": rule_column(host, path, rules, 0), "by_rule": rule_column(host, path, rules, 1)})

    urls = judged.where("url is not null").groupBy("url").agg(F.first("by_rule").alias("by_rule"), F.count(F.lit(1)).alias("n"))
    labelled = urls.where("by_rule is not null").select(
        "url", (F.col("by_rule") == "allow").cast("long").alias("good"), (F.pmod(F.crc32("url"), F.lit(HELD_OUT)) == 0).alias("held")
    )
    labelled = materialize(labelled, "url-labels")
    open_urls = materialize(urls.where("by_rule is null").select("url", "n"), "url-open")
    rows = open_urls.agg(F.sum("n")).first()[0] or 0
    common = open_urls.where(F.col("n") * COMMON >= rows).select("url")
    open_urls = open_urls.select("url")
    scores = url_scores(open_urls.union(labelled.where("held").select("url")), labelled.where("not held"))
    scores = materialize(scores, "url-scores")
    cut = calibrated_threshold(scores.join(labelled.where("held"), "url"))

    first = scores.join(F.broadcast(common), "url", "left_semi").select("url", F.col("score").alias("known"))
    free = judged.where("by_rule is null").join(F.broadcast(first), "url", "left")
    # Rows that have their score, or none to get, are dealt out by a key that meets nothing.
    settled = F.col("known").isNotNull() | url.isNull()
    key = F.when(settled, F.concat(F.lit("\x01"), F.monotonically_increasing_id().cast("string"))).otherwise(F.concat(F.lit("\x02"), url))
    others = scores.select(F.concat(F.lit("\x02"), F.col("url")).alias("key"), F.col("score").alias("found"))
    free = free.withColumn("key", key).join(others, "key", "left").withColumn("score", F.coalesce("known", "found", F.lit(0.0))).drop("key", "known", "found")
    free = free.withColumn("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    fixed = judged.where("by_rule is not null").withColumns({"score": F.lit(None).cast("double"), "verdict": F.col("by_rule")})
    return free.unionByName(fixed).drop("by_rule")

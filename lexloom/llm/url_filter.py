"""URL filter: host and path rules first, a character language-model ratio for the rest.

Only DataFrame functions. Two smoothed variable-order Markov models, one of accepted and one of
rejected URLs (those that a rule decides), give each character of a URL a log-likelihood
difference; a URL's verdict is its mean difference against a threshold. The threshold is calibrated
on URLs that rules decide and the models have not seen: those whose md5 begins with HELD_OUT.

Scale: all counting is over distinct character windows after a map-side combine. Scoring
broadcasts the differences of at most SLOTS frequent windows, whatever the input; the other
windows of a URL, counted by URL, are joined with the stored table of all windows. Every window
has its own difference. Of the pages only page_id and url are shuffled, once before scoring and
once to add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, head_threshold, stored

#: (rule, verdict); a rule is a host, then a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Characters of context at most.
ORDER = 4
#: Rows of the broadcast table of log-likelihood differences, at most.
SLOTS = 1 << 18
#: Steps of the score in which the threshold is looked for, per unit.
GRAIN = 50
#: First hexadecimal digits of the md5 of the ruled URLs that only calibrate: 3 in 16.
HELD_OUT = ("0", "1", "2")
_PAD, _END = "\u0002", "\u0003"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or where there is no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _windows(url: Column) -> Column:
    """Each character (and the end) with the ORDER characters before it."""
    padded = F.concat(F.lit(_PAD * ORDER), url, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substring(padded, i, ORDER + 1))


def window_differences(counts: DataFrame) -> DataFrame:
    """(gram, weight, diff) for (gram, n, n_allow, n_block): interpolated (Witten-Bell) models of
    orders 0 to ORDER for both classes; an unseen context falls back to the shorter one.

    All orders go through the same few shuffles, told apart by k.
    """
    order = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
    suffix = F.substring(F.col("gram"), F.lit(ORDER + 1) - F.col("k"), F.col("k") + 1)
    spread = counts.select("gram", "n", "n_allow", "n_block", order).withColumn("g", suffix)
    at_k = spread.groupBy("k", "g").agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b"))
    same = W.partitionBy("k", F.substring(F.col("g"), F.lit(1), F.col("k")))  # a row for each following character
    at_k = at_k.withColumns({
        "na": F.sum("a").over(same), "nb": F.sum("b").over(same),
        "ta": F.sum((F.col("a") > 0).cast("long")).over(same), "tb": F.sum((F.col("b") > 0).cast("long")).over(same)})
    # at k = 0 many windows share a character: stored, so that a plain join follows, which Spark splits where keys are common
    at_k = stored(at_k, "url-orders")
    orders = spread.select("gram", "n", "k", "g").join(at_k, ["k", "g"]).groupBy("gram").agg(
        F.max("n").alias("weight"), F.sort_array(F.collect_list(F.struct("k", "a", "b", "na", "nb", "ta", "tb"))).alias("orders"))  # ORDER + 1 entries

    def probability(n: str, total: str, kinds: str) -> Column:
        def blend(below, x):
            return F.when(x[total] > 0, (x[n] + x[kinds] * below) / (x[total] + x[kinds])).otherwise(below)
        return F.aggregate("orders", F.lit(1 / 256), blend)

    return orders.select("gram", "weight", F.log(probability("a", "na", "ta") / probability("b", "nb", "tb")).alias("diff"))


def held_out(url: Column) -> Column:
    """URLs that calibrate, if a rule decides them; the others train."""
    return F.substring(F.md5(url), 1, 1).isin(*HELD_OUT)


def threshold(scored: DataFrame) -> float:
    """The cut of least balanced error over the held-out URLs that rules decide, the lowest of equal
    ones; over all of them if either side has none held out; 0 if one side is empty altogether."""
    ruled = scored.filter("ruled is not null")
    first = _cut(ruled.filter(held_out(F.coalesce("url", F.lit("")))))
    second = first if first is not None else _cut(ruled)
    return 0.0 if second is None else second


def _cut(ruled: DataFrame) -> float | None:
    bins = ruled.groupBy(F.floor(F.col("score") * GRAIN).alias("bin")).agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("copies")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("ruled") == "block", F.col("copies")).otherwise(0)).alias("b"))
    rows = sorted(bins.filter("bin is not null").collect())  # at most GRAIN * range of log(p/q) rows
    all_a, all_b = sum(r.a for r in rows), sum(r.b for r in rows)
    if not all_a or not all_b:
        return None
    best, cut, below_a, below_b = None, 0.0, 0, 0
    for r in rows:  # cut below this bin
        error = below_a / all_a + (all_b - below_b) / all_b
        if best is None or error < best:
            best, cut = error, r.bin / GRAIN
        below_a, below_b = below_a + r.a, below_b + r.b
    return float(cut)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of `pages`.

    Null urls, and urls without `://`, have an empty host and path, hence no rule, and are judged
    by the models as they stand (null: as an empty url). A score equal to the threshold is "allow".
    Very long urls are read whole. Null page_ids stay null; equal rows come out as often as they went
    in, and other urls of an equal page_id are rows of their own. Other columns are not looked at,
    whatever their names. Without any ruled url both models are uniform, every score is 0 and every
    verdict "allow". An empty table gives no rows.
    """
    base = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    host, path = split_url(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": ruled})
    url = F.coalesce(F.col("url"), F.lit(""))
    counts = stored(
        base.select("copies", F.when(~held_out(url), F.col("ruled")).alias("teaches"), F.explode(_windows(url)).alias("gram")).groupBy("gram").agg(
            F.sum("copies").alias("n"),
            F.sum(F.when(F.col("teaches") == "allow", F.col("copies")).otherwise(0)).alias("n_allow"),
            F.sum(F.when(F.col("teaches") == "block", F.col("copies")).otherwise(0)).alias("n_block")), "url-grams")
    every = stored(window_differences(counts).select("gram", F.col("weight").alias("n"), "diff"), "url-differences")
    at = head_threshold(every, SLOTS)
    head = every.filter(F.col("n") >= at).select("gram", "diff")  # at most SLOTS rows
    tail = every.filter(F.col("n") < at).select("gram", "diff")
    part = stored(
        base.select("page_id", "url", "copies", F.explode(_windows(url)).alias("gram")).join(F.broadcast(head), "gram", "left")
        .groupBy("page_id", "url", "copies").agg(
            F.count("*").alias("windows"), F.coalesce(F.sum("diff"), F.lit(0.0)).alias("total"),
            F.collect_list(F.when(F.col("diff").isNull(), F.col("gram"))).alias("rest")), "url-parts")
    zero = F.lit(0).cast("long")
    pairs = part.select("page_id", "url", F.explode("rest").alias("gram")).groupBy("page_id", "url", "gram").agg(F.count("*").alias("times"))
    found = pairs.join(tail, "gram").select("page_id", "url", zero.alias("copies"), zero.alias("windows"), (F.col("times") * F.col("diff")).alias("total"))
    summed = part.drop("rest").unionByName(found).groupBy("page_id", "url").agg(*(F.sum(c).alias(c) for c in ("copies", "windows", "total")))
    scored = stored(
        summed.select("page_id", "url", "copies", host.alias("host"), path.alias("path"), (F.col("total") / F.col("windows")).alias("score"))
        .withColumns({"rule": rule, "ruled": ruled}), "url-scores")
    cut = threshold(scored)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

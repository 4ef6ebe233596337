"""URL filter: rules first, then the ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowboard.llm.common import cut

_SPLIT = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4
ALPHABET = 256
START, END = "\u0002", "\u0003"
MICRO = 1_000_000
#: Width of the bins, in micro-nats, between which thresholds are tried.
STEP = 10_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule `host/path...` that fits the host or a parent domain; nulls if none."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def gram_table(labelled: DataFrame, order: int) -> DataFrame:
    """Log-likelihood ratio in micro-nats of every gram of `order` + 1 characters.

    `labelled` has (gram, n_allow, n_block): how often a gram's last character followed its first
    `order` ones in accepted and in rejected URLs, zeros included. Each model blends all orders
    from 0 up: a context seen n times with u different followers gives n / (n + u) of the weight to
    its own frequencies and the rest to the context one character shorter (Witten-Bell); below
    order 0 lies the uniform distribution. A context that was never seen passes everything down,
    so the order used varies with what training holds.
    """
    table = labelled
    sides = ("allow", "block")
    for side in sides:
        table = table.withColumn(f"p_{side}", F.lit(1.0 / ALPHABET))
    for k in range(order + 1):
        table = table.withColumn("tail", F.substring("gram", order - k + 1, k + 1)).withColumn("context", F.substring("gram", order - k + 1, k))
        tails = table.groupBy("tail", "context").agg(*[F.sum(f"n_{s}").alias(f"c_{s}") for s in sides])
        contexts = tails.groupBy("context").agg(
            *[F.sum(f"c_{s}").alias(f"t_{s}") for s in sides], *[F.sum((F.col(f"c_{s}") > 0).cast("bigint")).alias(f"u_{s}") for s in sides])
        table = table.join(tails.drop("context"), "tail").join(contexts, "context")
        for s in sides:
            table = table.withColumn(f"p_{s}", F.when(F.col(f"t_{s}") == 0, F.col(f"p_{s}")).otherwise(
                (F.col(f"c_{s}") + F.col(f"u_{s}") * F.col(f"p_{s}")) / (F.col(f"t_{s}") + F.col(f"u_{s}"))))
        table = cut(table.select("gram", *[f"n_{s}" for s in sides], *[f"p_{s}" for s in sides]))
    return table.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * MICRO).cast("bigint").alias("micro"))


def threshold(scored: DataFrame) -> int:
    """Micro-nats from which to allow: least mean of both error rates on (micro_mean, action).

    Scores are counted in bins of STEP, which bounds the table by their range; candidates lie
    half-way between neighbouring bins that hold urls. Of equally good ones the closest to 0 counts,
    then the lower. 0 if a class is missing.
    """
    bins = scored.groupBy(F.floor(F.col("micro_mean") / STEP).alias("bin")).agg(
        F.sum((F.col("action") == "allow").cast("bigint")).alias("good"), F.sum((F.col("action") == "block").cast("bigint")).alias("bad"))
    from pyspark.sql import Window

    by_bin = Window.orderBy("bin")
    below = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    errors = bins.select(
        ((F.coalesce(F.lag("bin").over(by_bin), F.col("bin") - 1) + 1 + F.col("bin")) * (STEP // 2)).alias("cut"), F.sum("good").over(whole).alias("goods"), F.sum("bad").over(whole).alias("bads"),
        F.coalesce(F.sum("good").over(below), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("stopped")).where("goods > 0 and bads > 0")
    # lost / goods + (bads - stopped) / bads over the common denominator, so ties are exact.
    best = errors.orderBy(F.expr("lost * bads + (bads - stopped) * goods"), F.abs("cut"), "cut").first()
    return int(best["cut"]) if best else 0


def judge(pages: DataFrame, rules: list[tuple[str, str]], order: int = ORDER) -> DataFrame:
    """Verdict on every url: page_id, host, path, rule, verdict, score.

    Where a rule fits, the longest one decides. Every other url is scored by two variable-order
    Markov models over characters, trained on the urls that rules accept and reject: the difference
    of their log-likelihoods, divided by the number of characters (an end mark included). It is
    allowed if that reaches the threshold. Models learn from the labelled urls whose hash modulo 5
    is not 0 and the threshold is set on the rest. Each different url counts once, whatever the
    number of pages. Log ratios are rounded to millionths of a nat before adding, so results do
    not depend on the order of the rows.

    A null or empty url has empty host and path and is scored as the end mark alone; without labels
    of both classes all scores are 0 and urls are allowed. Repeated rows give repeated results,
    an empty table none.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    fold = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 7), 16, 10).cast("bigint") % 5
    urls = parts.select("url", action.alias("action"), fold.alias("fold")).distinct()
    padded = F.concat(F.lit(START * order), F.lower("url"), F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length("url") + 1), lambda i: padded.substr(i, F.lit(order + 1)))
    at = urls.select("url", "action", "fold", F.explode(grams).alias("gram"))
    fits = lambda side: F.sum(((F.col("action") == side) & (F.col("fold") != 0)).cast("bigint"))
    counted = at.groupBy("gram").agg(F.coalesce(fits("allow"), F.lit(0)).alias("n_allow"), F.coalesce(fits("block"), F.lit(0)).alias("n_block"))
    ratios = gram_table(cut(counted), order)
    scored = cut(at.join(ratios, "gram").groupBy("url", "action", "fold").agg((F.sum("micro") / F.count(F.lit(1))).alias("micro_mean")))
    least = threshold(scored.where("fold = 0 and action is not null"))
    verdict = F.coalesce("action", F.when(F.col("micro_mean") >= least, "allow").otherwise("block"))
    return parts.join(scored.select("url", "micro_mean", "action"), "url").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round(F.col("micro_mean") / MICRO, 6).alias("score"))

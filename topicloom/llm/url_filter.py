"""URL filter: rules first, then a ratio of two character language models, in DataFrame functions only.

Two smoothed Markov models of variable order are counted over all URLs that the rules decide: one of accepted, one of rejected URLs. The
probability of a character after its last `order` characters is interpolated (Witten-Bell) with that after one character
fewer, down to single characters; contexts seen fewer than MIN_CONTEXT times in a model are left to the shorter one. A URL's score is the
difference of its two log-likelihoods per character. The threshold is calibrated on URLs held out of the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

START, END = "\u0002", "\u0003"
ORDER = 4
MIN_CONTEXT = 3
HELD_OUT = "012"  # first hexadecimal digits of md5(url): three URLs in sixteen calibrate
UNIT = 1_000_000  # log ratios are summed as whole millionths, so that the sum has no order
BIN = 10_000.0  # width of a score bin in these units
HOT_SHARE = 1000  # a gram with more than 1/1000 of all places is hot: fewer than 1000 of them

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column, field: str) -> Column:
    """The verdict or the text (host and path) of the longest rule that fits; of equally long ones, that of the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    out = F.lit(None).cast("string")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(verdict if field == "verdict" else h + p)).otherwise(out)
    return out


def _places(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """keep..., gram: one row for each character of `url` and its end, with the `order` characters before it."""
    chars = F.split(F.concat(F.lit(START * order), "url", F.lit(END)), "")
    rows = urls.select(*keep, chars.alias("chars"), (F.length("url") + 1).alias("places"))
    shifted = [F.slice("chars", i + 1, F.col("places")).alias(f"c{i}") for i in range(order + 1)]
    rows = rows.select(*keep, F.explode(F.arrays_zip(*shifted)).alias("c"))
    return rows.select(*keep, F.concat(*[F.col("c")[f"c{i}"] for i in range(order + 1)]).alias("gram"))


def log_ratios(grams: DataFrame, order: int) -> DataFrame:
    """gram, ratio: for each row of `grams` (gram, yes, no) the log ratio of its last character after the others, in millionths.

    Everything here has one row for each kind of gram or context, however often it occurs; nothing is gathered on the driver but totals.
    """
    n, yes, no = grams.agg(F.count_distinct(F.right("gram", F.lit(1))), F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("no"), F.lit(0))).first()
    totals = {"yes": yes, "no": no}
    shorter = None
    for k in range(order + 1):
        counts = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("s")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        if k == 0:
            shorter = counts.select("s", *[((F.col(x) + 1.0) / (totals[x] + n)).alias(f"p_{x}") for x in totals])
            continue
        counts = counts.withColumn("context", F.expr(f"left(s, {k})"))
        sums = [F.sum(x).alias(f"n_{x}") for x in totals] + [F.count_if(F.col(x) > 0).alias(f"kinds_{x}") for x in totals]
        contexts = counts.groupBy("context").agg(*sums)
        rows = counts.join(contexts, "context").withColumn("rest", F.right("s", F.lit(k)))
        rows = rows.join(shorter.withColumnRenamed("s", "rest"), "rest")

        def smoothed(x: str) -> Column:
            seen, kinds = F.col(f"n_{x}"), F.col(f"kinds_{x}")
            mixed = (F.col(x) + kinds * F.col(f"p_{x}")) / (seen + kinds)
            return F.when(seen >= MIN_CONTEXT, mixed).otherwise(F.col(f"p_{x}")).alias(f"p_{x}")

        shorter = rows.select("s", *[smoothed(x) for x in totals])
    ratio = F.round((F.log("p_yes") - F.log("p_no")) * UNIT).cast("long")
    return shorter.select(F.col("s").alias("gram"), ratio.alias("ratio"))


def _scores(urls: DataFrame, grams: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """url_hash, bin: the score bin of each row of `urls` (url, url_hash).

    Hot grams (fewer than 1000, a proven bound) are broadcast and the places they fill are summed before anything is shuffled; the rest meets its
    ratios by a join in which no key has more than a thousandth of the rows.
    """
    total = grams.agg(F.sum("n")).first()[0] or 0
    model = materialize(grams.join(ratios, "gram").select("gram", "ratio", (F.col("n") * HOT_SHARE > total).alias("hot")), "url-model")
    hot = model.filter("hot").select(F.col("gram").alias("hot_gram"), F.col("ratio").alias("hot_ratio"))
    places = _places(urls, order, "url_hash").join(F.broadcast(hot), F.col("gram") == F.col("hot_gram"), "left")
    places = places.groupBy("url_hash", F.when(F.col("hot_ratio").isNull(), F.col("gram")).alias("gram"))
    places = places.agg(F.sum("hot_ratio").alias("sum"), F.count("*").alias("n"))
    cold = model.filter("not hot").select(F.col("gram").alias("g"), "ratio")
    joined = places.join(cold, F.col("gram") == F.col("g"), "left")
    score = F.sum(F.coalesce(F.col("sum"), F.lit(0)) + F.coalesce(F.col("ratio") * F.col("n"), F.lit(0)))
    return joined.groupBy("url_hash").agg(F.floor(score / (F.sum("n") * BIN)).alias("bin"))


def threshold(bins: DataFrame) -> int:
    """The bin from which on URLs are accepted: where the sum of both shares judged right is best, the least of equals, in the middle of the
    gap to the bin before.

    `bins` has bin, yes and no. A log ratio is bounded by the logarithm of the counts, so there are some thousands of bins, however many URLs.
    Without held-out URLs of both kinds it is bin 0, equal likelihood.
    """
    rows = sorted((r.bin, r.yes, r.no) for r in bins.groupBy("bin").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect())
    yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not yes or not no:
        return 0
    best, at, before, kept, refused = -1, 0, None, yes, 0
    for b, y, n in rows:
        if kept * no + refused * yes > best:
            best, at = kept * no + refused * yes, b if before is None else (before + b + 1) // 2
        before, kept, refused = b, kept - y, refused + n
    return at


def url_filter(pages: DataFrame, rules: Sequence[Rule], url_column: str = "url", order: int = ORDER) -> DataFrame:
    """All columns of `pages` and a struct `judged`, one row per row.

    judged has host, path, rule (its host and path; null if none fits), score_bin (hundredths of a nat per character, rounded down; null where
    a rule decides) and verdict, allow or block. `rules` are (verdict, host, path): a rule fits its host and all subdomains if the path
    starts with its own; the longest wins. A null URL is judged as the empty one, which has only its end to be judged by.
    Repeated URLs count as often as they occur and get one verdict. Scores in the threshold's bin are accepted. Where no rule accepts or
    none rejects, there is nothing to compare and both models are uniform over the characters seen. An empty table stays
    empty. A column named `judged` is replaced; select the columns you need first, as whole rows move with their URL.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "judged"])
    read = pages.select(row.alias("page"), F.coalesce(F.col(url_column), F.lit("")).alias("url"))
    read = read.withColumn("url_hash", F.xxhash64("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    decided = longest_rule(rules, host, path, "verdict")

    urls = read.groupBy("url", "url_hash").agg(F.count("*").alias("rows"))
    held = F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)
    urls = materialize(urls.select("url", "url_hash", "rows", decided.alias("label"), held.alias("held")), "urls")
    training = ~F.col("held")

    def count_of(verdict: str, where: Column) -> Column:
        return F.when((F.col("label") == verdict) & where, F.col("rows")).otherwise(F.lit(0).cast("long"))

    counted = urls.withColumns({"yes": count_of("allow", training), "no": count_of("block", training)})
    grams = _places(counted, order, "rows", "yes", "no").groupBy("gram")
    grams = materialize(grams.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.sum("rows").alias("n")), "grams")
    scored = urls.filter("label is null or held")
    bins = materialize(_scores(scored, grams, log_ratios(grams, order), order), "scores")
    known = urls.filter("label is not null and held").join(bins, "url_hash")
    least = threshold(known.select("bin", count_of("allow", F.lit(True)).alias("yes"), count_of("block", F.lit(True)).alias("no")))

    joined = read.join(bins.withColumnRenamed("url_hash", "scored_hash"), F.col("url_hash") == F.col("scored_hash"), "left")
    by_model = F.when(F.col("bin") >= least, F.lit("allow")).otherwise(F.lit("block"))
    judged = F.struct(
        host.alias("host"),
        path.alias("path"),
        longest_rule(rules, host, path, "rule").alias("rule"),
        F.when(decided.isNull(), F.col("bin")).alias("score_bin"),
        F.coalesce(decided, by_model).alias("verdict"),
    )
    return joined.select("page.*", judged.alias("judged"))

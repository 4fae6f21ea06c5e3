"""Keys, times, percentages, categories, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_YEAR = 9999

# Ordered domains of the corpus metadata.
SERIES = ["mmwr", "mmnd", "mmrr", "mmss", "mmsu", "eid", "eid0", "eid1", "eid2", "pcd"]
LEVEL = ["home", "series", "volume", "issue", "article"]
STRATUM = ["mmwr_toc", "mmwr_art", "eid_toc", "eid_art", "pcd_toc", "pcd_art"]
COLLECTION = [
    "mmwr_toc_en", "mmrr_toc_en", "mmss_toc_en", "mmsu_toc_en", "mmwr_art_en", "mmrr_art_en", "mmss_art_en",
    "mmsu_art_en", "mmnd_art_en", "mmwr_art_es", "eid_toc_en", "eid0_art_en", "eid1_art_en", "eid2_art_en",
    "pcd_toc_en", "pcd_toc_es", "pcd_art_en", "pcd_art_es", "pcd_art_fr", "pcd_art_zhs", "pcd_art_zht",
]


def percent_to_number(text: Column) -> Column:
    """'87%' -> 87.0: the last character is dropped, whatever it is."""
    return F.substring(text, F.lit(1), F.length(text) - 1).try_cast("double")


def year_or_sentinel(date_text: Column) -> Column:
    """Year of a YYYY-MM-DD or YYYY-MM text, 9999 when there is none."""
    full = F.when(F.length(date_text) == 7, F.concat(date_text, F.lit("-01"))).otherwise(date_text)
    return F.coalesce(F.year(full.try_cast("date")), F.lit(NO_YEAR))


def category_ordinal(value: Column, domain: list[str]) -> Column:
    """Position in the ordered domain from 0, null outside it."""
    where = F.array_position(F.array(*[F.lit(d) for d in domain]), value)
    return F.when(where > 0, (where - 1).cast("int"))


def in_domain(value: Column, domain: list[str]) -> Column:
    """The value itself, null outside the domain."""
    return F.when(value.isin(domain), value)


def time_key(ts: Column) -> Column:
    """md5 of the time written as yyyyMMddHHmmss and six digits of microseconds."""
    return F.md5(F.date_format(ts, "yyyyMMddHHmmssSSSSSS"))


def text_md5(text: Column) -> Column:
    return F.md5(text)


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def elapsed_minutes(start: Column, end: Column) -> Column:
    return F.round(elapsed_seconds(start, end) / 60, 2)


def repaired_score(score: Column) -> Column:
    """Text to number; everything that is not a finite number becomes 0."""
    number = score.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, number).otherwise(F.lit(0.0))


def perplexity_base2(per_word_bound: Column) -> Column:
    return F.pow(F.lit(2.0), -per_word_bound)


def strongest_topic(distribution: Column) -> Column:
    """Index of the largest share, the first on a tie."""
    return (F.array_position(distribution, F.array_max(distribution)) - 1).cast("int")


def topic_label(distribution: Column) -> Column:
    return F.concat(F.lit("Topic "), strongest_topic(distribution).cast("string"))


def prefix_texts(tokens: Column) -> Column:
    """Array of the texts of the first 1, 2, ... tokens; use operators.corpus.prefix_rows for long documents."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(F.slice(tokens, 1, i), " "))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two arrays of shares, natural logarithm, 0 log 0 = 0."""
    def half(a: Column, b: Column) -> Column:
        def term(x: Column, y: Column) -> Column:
            return F.when(x > 0, x * F.log(x / ((x + y) / 2))).otherwise(F.lit(0.0))

        return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)

    return (half(p, q) + half(q, p)) / 2

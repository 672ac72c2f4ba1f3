"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import stable
from logweave.operators.joins import fits_broadcast
from logweave.operators.once import once
from logweave.session import freeze

#: Hash buckets of the two multinomials; also the bound of the table that is broadcast.
BUCKETS = 1 << 16
#: Added to each bucket's count.
SMOOTHING = 1.0
#: A text is kept if its mean log ratio per n-gram is this or more.
THRESHOLD = -0.3
MIN_WORDS = 50
#: White space between words; an n-gram's tokens, runs of letters and digits and runs of other signs.
_SPACE = r"[\x20\x09-\x0D]+"
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
_SCALE = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def signals(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and the counts that the rules look at."""
    made = once(df, {"_w": _words(F.coalesce(F.col(text), F.lit(""))),
                     "_l": F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                                    lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                     "n_symbols": F.regexp_count(F.coalesce(F.col(text), F.lit("")),
                                                 F.lit(r"[#*$%&|<>]")).cast("long")}, keep)
    n = F.size("_w")
    made = once(made, {
        "n_words": n.cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        # hashes of the windows of three words
        "_h": F.when(n >= 3, F.transform(
            F.slice("_w", 1, F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))))
        .otherwise(F.array().cast("array<bigint>"))}, [*keep, "n_symbols"])
    base = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    # where windows repeat: (hash, place) in order of hash, so that equal windows are neighbours
    made = once(made, {"_s": F.when(F.size(F.array_distinct("_h")) == F.size("_h"), none).otherwise(
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))}, base)
    made = once(made, {"_p": F.sort_array(F.transform(F.filter("_s", lambda x, k: (
        (F.get("_s", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("_s", k + 1)["h"].eqNullSafe(x["h"])))),
        lambda x: x["i"]))}, base)
    # each repeated window adds the words that the one before it has not covered
    return made.select(*base, F.aggregate(
        F.transform("_p", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get("_p", k - 1)))),
        F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def base_failed() -> Column:
    """The fixed rules: too few words, or over half the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ngrams(df: DataFrame, text: str, keep: list[str], buckets: int) -> DataFrame:
    """One row per unigram and bigram: columns ``keep`` and the ``bucket`` of its hash.

    Tokens are runs of letters and digits, and runs of other signs, in all of Unicode. The
    first token of a text has none before it; as a bigram it is hashed alone.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_TOKEN), F.lit(0))
    made = once(df, {"_t": tokens}, keep).select(*keep, "_t", F.posexplode("_t").alias("_i", "_x"))
    # hashed a row per token, in generated code: lambdas over arrays are interpreted
    hashed = F.array(F.xxhash64("_x"), F.xxhash64(F.get("_t", F.col("_i") - 1), "_x"))
    return made.select(*keep, F.explode(hashed).alias("_h")).select(
        *keep, F.pmod("_h", F.lit(buckets)).alias("bucket"))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS,
               smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, ratio): log of trusted over raw probability, in millionths, for each bucket seen.

    Raw counts are over all rows of ``docs``, trusted ones over those whose
    doc_id is in ``trusted`` (repeats count once, nulls never). Without trusted
    n-grams all ratios are zero. Has as many rows as buckets at most.
    """
    ids = freeze(trusted.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct())
    marked = docs.select("doc_id", F.col(text).alias("_text")).join(
        F.broadcast(ids) if fits_broadcast(ids) else ids, F.col("doc_id") == F.col("_id"), "left")
    counts = (_ngrams(marked, "_text", ["_id"], buckets).groupBy("bucket")
              .agg(F.count("*").alias("raw"), F.count("_id").alias("good")))
    counts = freeze(counts)
    raw, good = counts.agg(F.sum("raw"), F.sum("good")).first()
    if not good:
        return counts.select("bucket", F.lit(0).cast("long").alias("ratio"))
    shift = math.log((raw + smoothing * buckets) / (good + smoothing * buckets))
    ratio = F.log((F.col("good") + smoothing) / (F.col("raw") + smoothing)) + F.lit(shift)
    return counts.select("bucket", F.round(ratio * _SCALE).cast("long").alias("ratio"))


def judge(docs: DataFrame, trusted: DataFrame, text: str = "text", threshold: float = THRESHOLD,
          buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, log_ratio, kept.

    ``log_ratio`` is the mean over the text's unigrams and bigrams of the log
    ratio between the trusted and the raw multinomial over hash buckets (0 for
    texts without any). Sums are of whole numbers, so the result does not
    depend on their order. Null and empty texts have zero counts and fail the
    base rules; null and repeated doc_ids give a row each; other columns are
    ignored; an empty table gives no rows.

    Text is never shuffled: n-grams meet the ratios in a broadcast table of at
    most ``buckets`` rows and are summed up per row before the one small shuffle.
    Trusted ids are broadcast while they are measured small, else joined by shuffle.
    """
    docs = stable(docs)
    ratios = freeze(log_ratios(docs, trusted, text, buckets, smoothing))
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"),
                        F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    # the bound of the table is the number of buckets
    sums = (_ngrams(keyed, "_text", ["_row"], buckets).join(F.broadcast(ratios), "bucket")
            .groupBy("_row").agg(F.sum("ratio").alias("_sum"), F.count("*").alias("_n")))
    base = signals(keyed, "_text", ["_row", "doc_id"])
    joined = base.join(sums, "_row", "left")
    ratio = F.coalesce(F.col("_sum") / (F.col("_n") * F.lit(_SCALE)), F.lit(0.0))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed().alias("base_failed"),
                         (~base_failed() & (ratio >= threshold)).alias("kept"), ratio.alias("log_ratio"))

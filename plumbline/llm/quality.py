"""Operator 10: quality rules, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows.
The verdict on what passes them is a hashed n-gram log-likelihood ratio: hashed
words and word pairs of trusted texts and of the whole raw corpus make two
smoothed multinomials, a text's score is the mean log ratio of its features, and
a text is kept if its score isn't below a threshold set once from the trusted
texts' scores (their mean less ``spread`` standard deviations). The threshold is
applied to every document alike; nothing is drawn at random.

All counts cover every row, and the trusted ones, like the threshold, every trusted
text. The number of hashed counts grows with the cube root of the corpus, in powers
of 2: twice ``FEATURES`` up to ``GROWS`` bytes of text, 16 times as many at 4,096
times as much text (about a million for 100 TB, 8 MB).

Defined results: a null text is an empty one; it has no words and fails the base
rules. Without trusted texts or without words in the corpus all ratios are 0 and
the verdict is true. Repeated rows are judged each; an empty table gives an empty
table; other columns are kept by ``judged`` (which
replaces those named as its own) and ``kept_rows``, and ignored by ``quality``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SQL, stored

#: Hashed features of words, and as many of word pairs, of a corpus of up to GROWS bytes; twice as many for each eightfold corpus.
FEATURES, GROWS = 4096, 50_000_000
SMOOTHING = 1.0
SPREAD = 7.0
#: Up to so many trusted ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
MIN_WORDS = 50
MAX_REPEATED = 50
#: The columns of the base rules.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Up to so many repeated windows are looked up one by one; more are found by sorting.
FEW = 16


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def _covered(starts: Column) -> Column:
    """The number of words in the windows that start at these places."""
    later = lambda k: F.transform(starts, lambda i: i + k)
    return F.size(F.array_union(F.array_union(starts, later(1)), later(2)))


def with_base(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the array _w of words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_w", _words(text_col)).withColumn("_n", F.size("_w"))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    places = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_t", F.transform(places, window))
    # windows that occur twice or more: equal neighbours among the sorted hashes
    df = df.withColumn("_s", F.sort_array("_t"))
    again = F.filter(F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    df = df.withColumn("_d", F.array_distinct(again)).drop("_s")
    few = F.filter(F.transform("_t", lambda x, i: F.when(F.array_contains("_d", x), i)), lambda x: x.isNotNull())
    spots = F.array_sort(F.transform("_t", lambda x, i: F.struct(x.alias("t"), i.alias("i"))))
    df = df.withColumn("_spots", F.when(F.size("_d") > FEW, spots))
    behind = F.zip_with("_spots", F.slice("_spots", 2, F.greatest(F.size("_spots"), F.lit(1))), lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"])))
    many = F.array_distinct(F.flatten(F.filter(behind, lambda x: x.isNotNull())))
    df = df.withColumn("_starts", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= FEW, few).otherwise(many))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_SQL))
    df = df.withColumn("_lines", lines)
    n, repeated = F.col("_n").cast("long"), _covered(F.col("_starts")).cast("long")
    df = df.withColumn(prefix + "n_words", n).withColumn(prefix + "word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn(prefix + "n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn(prefix + "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn(prefix + "n_repeat_words", repeated)
    failed = (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEATED * F.col(prefix + "n_words"))
    return df.withColumn(prefix + "base_failed", failed).drop("_t", "_d", "_spots", "_starts", "_lines", "_n")


def _word_feature(w: Column, features: int) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(features)).cast("int")


def _pair_feature(a: Column, b: Column, features: int) -> Column:
    return (F.pmod(F.xxhash64(a, b), F.lit(features)) + features).cast("int")


def _pairs(w: Column, features: int) -> Column:
    """Features of the pairs of neighbours; null for the last word, which has none."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(b.isNotNull(), _pair_feature(a, b, features)))


def feature_counts(words: DataFrame, features: int) -> dict[int, tuple[int, int]]:
    """Per feature: its count over all rows and over the trusted ones (column _t); at most 2 * features rows reach the driver."""
    both = F.concat(F.transform("_w", lambda x: _word_feature(x, features)), F.filter(_pairs(F.col("_w"), features), lambda x: x.isNotNull()))
    rows = words.select(F.col("_t").cast("long").alias("t"), F.explode(both).alias("f"))
    return {r["f"]: (r["n"], r["t"]) for r in rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect()}


def log_ratios(counts: dict[int, tuple[int, int]], features: int, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_trusted / p_raw) of every feature, words and pairs each a multinomial; 0 where there is nothing to learn from."""
    out: list[float] = []
    for first in (0, features):
        raw = [counts.get(first + i, (0, 0))[0] for i in range(features)]
        good = [counts.get(first + i, (0, 0))[1] for i in range(features)]
        if not sum(raw) or not sum(good):
            out += [0.0] * features
            continue
        a, b = math.log(sum(good) + smoothing * features), math.log(sum(raw) + smoothing * features)
        out += [round(math.log(g + smoothing) - a - math.log(r + smoothing) + b, 6) for g, r in zip(good, raw, strict=True)]
    return out


def _score(ratios: list[float]) -> Column:
    """The mean log ratio of a text's features; 0 for a text without words."""
    features = len(ratios) // 2
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    each = F.zip_with(
        "_w", F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))),
        lambda a, b: F.get(table, _word_feature(a, features)) + F.coalesce(F.get(table, _pair_feature(a, b, features)), F.lit(0.0)) * b.isNotNull().cast("int"),
    )
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size("_w") > 0, total / (2 * F.size("_w") - 1)).otherwise(F.lit(0.0))


def n_features(size: int) -> int:
    """Features of words for so many bytes of text."""
    doubled = 0
    while size > GROWS << 3 * doubled:
        doubled += 1
    return FEATURES << doubled


def fit(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: int | None = None, spread: float = SPREAD) -> tuple[list[float], float]:
    """The log ratios and the threshold. trusted_ids: one column of ids, all of which count."""
    i = F.col(trusted_ids.columns[0])
    ids = stored(trusted_ids.filter(i.isNotNull()).select(i.alias("_id")).distinct(), "trusted").withColumn("_known", F.lit(1))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    if features is None:
        features = n_features(rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("b")).first()["b"])
    words = rows.join(ids, F.col("_doc") == F.col("_id"), "left").select(_words("_text").alias("_w"), F.coalesce("_known", F.lit(0)).alias("_t"))
    ratios = log_ratios(feature_counts(words, features), features)
    trusted = words.filter("_t = 1").filter(F.size("_w") >= MIN_WORDS)
    scores = trusted.select(_score(ratios).alias("s")).agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    threshold = scores["m"] - spread * scores["d"] if scores["m"] is not None else -math.inf
    return ratios, float(threshold)


def judged(docs: DataFrame, model: tuple[list[float], float], text_col: str = "text") -> DataFrame:
    """Adds the base columns, score and kept."""
    ratios, threshold = model
    df = with_base(docs, text_col).withColumn("score", _score(ratios)).drop("_w")
    verdict = F.col("score") >= F.lit(threshold) if math.isfinite(threshold) else F.lit(True)
    df = df.withColumn("kept", ~F.col("base_failed") & verdict)
    found = [*BASE, "score", "kept"]
    # As a generator's output, the columns are computed once: a filter on one of them isn't moved below the rules' projections, where it would compute them anew for each of their uses.
    return df.select(*(c for c in docs.columns if c not in found), F.inline(F.array(F.struct(*found))))


def kept_rows(docs: DataFrame, model: tuple[list[float], float], text_col: str = "text") -> DataFrame:
    """The rows of docs whose verdict is true."""
    packed = docs.select(F.struct(*docs.columns).alias("_all"), F.col(text_col).alias("_text"))
    return judged(packed, model, "_text").filter("kept").select("_all.*")


def quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: int | None = None, spread: float = SPREAD) -> DataFrame:
    """Per row: doc_id, the base columns, score and kept."""
    model = fit(docs, trusted_ids, id_col, text_col, features, spread)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return judged(rows, model, "text").drop("text")

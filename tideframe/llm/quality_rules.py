"""Quality rules whose cutoffs are chosen with a guarantee, in DataFrame operations only.

features() measures each text; learn() chooses, for each stratum and rule, a cutoff from labelled holdouts; judge() applies
base rules and cutoffs.

A cutoff is safe if the exact binomial test rejects, with the count of good holdout documents that it would drop, that it
drops more than risk / rules of the stratum's good documents. Cutoffs of one rule are tried from the mildest on until the
first that isn't safe (a fixed sequence needs no correction); strata and rules share the error rate evenly (Bonferroni).
So with probability 1 - error, every stratum loses at most the share risk of its good documents to all rules together. Of
the safe cutoffs, the one that drops most bad documents is taken, the mildest of equals. A stratum with too few labels gets
no cutoffs, and only the base rules apply there. The ladders of cutoffs are fixed beforehand, so every label may count.

Defined results: null and empty texts have no words and fail the base rules; a null stratum is one of its own; labels that
are null or name no document don't count; a document labelled twice counts once for each label; repeated rows are judged
alike; empty tables give empty results. Two windows count as equal when their 64-bit hashes within one text are. Only the
named columns are used, others pass through judge() unless they bear a name that features() gives.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, words, written

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
RISK, ERROR = 0.1, 0.1
#: Thresholds of at most so many strata are broadcast; more are joined in the ordinary way.
BROADCAST_STRATA = 10_000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stutters"]

#: Ladder of each rule, mildest first, in thousandths; a document is dropped beyond it: above, or below where marked "-".
LADDERS = {
    "symbols": [2000, 1000, 800, 600, 500, 400, 300, 200, 150, 100, 50],
    "upper": [900, 800, 700, 600, 500, 400, 300, 200, 150],
    "stutters": [800, 600, 500, 400, 300, 200, 150, 100, 50],
    "long_words": [20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000, 6500],
    "-short_words": [1500, 2000, 2500, 2800, 3000, 3200, 3400],
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        twice = let(marked, lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.aggregate(places, start, step, lambda a: a["n"]))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(windows, covered))


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(text: Column) -> Column:
    """A struct of FEATURES, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) > 0)
    return let(
        F.struct(words(text).alias("w"), lines.alias("l"), text.alias("t")),
        lambda s: F.struct(
            *(
                c.cast("long").alias(n)
                for n, c in {
                    "n_words": F.size(s["w"]),
                    "word_chars": without(s["t"], SPACES),
                    "n_symbols": F.length(s["t"]) - without(s["t"], SYMBOLS),
                    "n_dup_lines": F.size(s["l"]) - F.size(F.array_distinct(s["l"])),
                    "n_repeat_words": repeated_words(s["w"]),
                    "n_upper": F.length(s["t"]) - without(s["t"], UPPER),
                    "n_stutters": F.size(F.filter(s["w"], lambda x, i: (i > 0) & (x == F.get(s["w"], i - 1)))),
                }.items()
            )
        ),
    )


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df and the columns FEATURES. They come from a generator of one row, below which no condition on them is pushed, so
    that a text is measured once."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in FEATURES], F.inline(F.array(measured(F.col(f"`{text}`")))))


def ratios() -> dict[str, Column]:
    """The measured value of each rule, in whole thousandths."""
    share = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return {"symbols": share("n_symbols", "n_words"), "upper": share("n_upper", "word_chars"), "stutters": share("n_stutters", "n_words"), "long_words": share("word_chars", "n_words"), "-short_words": share("word_chars", "n_words")}


def beyond(rule: str, value: Column, cutoff: Column) -> Column:
    return value < cutoff if rule[0] == "-" else value > cutoff


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Exact P(X <= k) of n draws at chance p; 1 where k is at or over the mean, as it is never small there."""
    odds, start = math.log(p / (1 - p)), F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        log = a["log"] + F.log((n - j + 1) / j) + odds
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    terms = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, start["sum"]).otherwise(terms)


def learn(measured_docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum and, for each rule, the cutoff or null. measured_docs has key, stratum and FEATURES."""
    marks = labels.select(F.col(key).alias("_k"), (F.col(label) == 1).alias("good")).where("good is not null and _k is not null")
    held = measured_docs.where(~base_failed()).select(F.col(key).alias("_k"), F.col(stratum).alias("stratum"), *[v.alias(r) for r, v in ratios().items()]).join(marks, "_k")
    counts = [F.count_if(F.col("good")).alias("n")]
    for rule, ladder in LADDERS.items():
        for i, cutoff in enumerate(ladder):
            out = beyond(rule, F.col(f"`{rule}`"), F.lit(cutoff))
            counts += [F.count_if(F.col("good") & out).alias(f"{rule}{i}g"), F.count_if(~F.col("good") & out).alias(f"{rule}{i}b")]
    counted = written(held.groupBy("stratum").agg(*counts), "quality-counts")
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).cast("long").alias("cutoff"), F.col(f"`{r}{i}g`").alias("k"), F.col(f"`{r}{i}b`").alias("bad")) for r, ladder in LADDERS.items() for i, c in enumerate(ladder)]))
    tests = counted.select("stratum", "n", steps.alias("s")).select("stratum", "n", "s.*").withColumn("p_value", binomial_tail(F.col("n"), F.col("k"), risk / len(LADDERS)))
    tests = tests.withColumn("unsafe", (F.col("p_value") > error / (max(1, counted.count()) * len(LADDERS))).cast("int"))
    reached = F.sum("unsafe").over(Window.partitionBy("stratum", "rule").orderBy("i"))
    chosen = tests.withColumn("reached", reached).where("reached = 0 and bad > 0").groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("bad", -F.col("i"))).alias("cutoff"))
    return chosen.groupBy("stratum").pivot("rule", list(LADDERS)).agg(F.max("cutoff"))


def judge(df: DataFrame, thresholds: DataFrame, stratum: str = "lang") -> DataFrame:
    """df (with FEATURES) and base_failed, kept and dropped_by, an array of the rules that drop the row."""
    few = thresholds.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    cut = thresholds.select(F.struct("stratum").alias("_stratum"), F.struct(*[F.col(f"`{r}`") for r in LADDERS]).alias("_cut"))
    joined = df.join(F.broadcast(cut) if few else cut, F.struct(F.col(f"`{stratum}`").alias("stratum")).eqNullSafe(F.col("_stratum")), "left")
    hits = F.array_compact(F.array(*[F.when(beyond(r, v, F.col("_cut")[r]), F.lit(r)) for r, v in ratios().items()]))
    return joined.withColumns({"base_failed": base_failed(), "dropped_by": hits}).withColumn("kept", ~F.col("base_failed") & (F.size("dropped_by") == 0)).drop("_stratum", "_cut")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, stratum, FEATURES, base_failed, dropped_by and kept of each document; each text is read once."""
    held = written(features(docs.select(key, stratum, text), text).drop(text), "quality-features")
    return judge(held, written(learn(held, labels, stratum, key), "quality-cutoffs"), stratum)


def good_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of docs that quality_rules keeps. Rows and measures are written side by side, so that each text is
    measured once and none is shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    held = written(rows.select("_row", F.inline(F.array(measured(F.col(f"_row.`{text}`"))))), "quality-rows")
    known = held.select(F.col(f"_row.`{key}`").alias(key), F.col(f"_row.`{stratum}`").alias(stratum), *FEATURES)
    cutoffs = written(learn(known, labels, stratum, key), "quality-cutoffs")
    return judge(held.withColumn("_by", F.col(f"_row.`{stratum}`")), cutoffs, "_by").where("kept").select("_row.*")

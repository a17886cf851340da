"""URL filters: host and path rules, and gradient-boosted trees on lexical features, in DataFrame operations only.

The longest rule that fits a URL decides; the URLs that rules decide are the labels from which the trees learn to judge
the rest. Each boosting step is a groupBy over the binned training rows: gradients and curvatures are summed, as whole
numbers so that sums don't depend on order, by node, feature and bin; the driver sees these histograms only (nodes x
features x bins). A fitted model is one column expression.

Learning reads at most TRAIN_ROWS different decided URLs with their counts, the first in the order of a hash, or all; suffix
statistics count all decided URLs, but for a training row the others only, lest its own label be among its features. Everything
else covers every URL.

Defined results: null URLs and URLs without "://" have an empty host and path, fit no rule and are judged by the trees on
features of nothing; without both kinds of labels the trees allow everything; equal URLs get equal verdicts; an empty
table gives no rows. Other columns pass through, but for those that share a name with a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

TRAIN_ROWS = 50_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 12, 3, 16, 0.4, 1.0, 20
SCALE = 1 << 20  # of gradients as whole numbers
#: Suffix statistics of at most so many suffixes are broadcast; more are joined in the ordinary way.
BROADCAST_SUFFIXES = 100_000

Rules = list[tuple[str, str]]  # (host and path, "allow" or "block")


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """df, host and path."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def decided(rules: Rules) -> tuple[Column, Column]:
    """Of host and path, the longest rule that fits and its verdict, or nulls; of equal lengths, block and then the lesser."""
    rule = verdict = F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", [-ord(c) for c in r[0]])):
        host, _, path = name.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Thousandths of a bit a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n == 0, 0).otherwise(F.round(1000 * bits)).cast("long")


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Whole-number features."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda c, p: F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0))
    share = lambda c, p: F.floor(1000 * count(c, p) / F.greatest(F.length(c), F.lit(1)))
    found = {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "labels": count(host, r"\."),
        "digits": share(u, "[0-9]"),
        "host_digits": share(host, "[0-9]"),
        "hyphens": count(host, "-"),
        "parameters": count(query, "[^&]+"),
        "query_length": F.length(query),
        "secure": u.startswith("https").cast("int"),
        "vowels": share(host, "[aeiou]"),
        "host_entropy": entropy(host),
        "path_entropy": entropy(path),
        "suffix_length": F.length(suffix(host)),
    }
    return {k: c.cast("long") for k, c in found.items()}


FEATURES = [
    *("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "parameters", "query_length"),
    *("secure", "vowels", "host_entropy", "path_entropy", "suffix_length", "suffix_count", "suffix_blocked"),
]


def suffix_statistics(train: DataFrame) -> DataFrame:
    """_suffix, _n and _blocked, how many decided URLs have it and how many of them are blocked."""
    return train.groupBy(suffix(F.col("host")).alias("_suffix")).agg(F.count("*").alias("_n"), F.count_if(F.col("verdict") == "block").alias("_blocked"))


def featured(df: DataFrame, statistics: DataFrame, url: str, few: bool, own: tuple[Column, Column] | None = None) -> DataFrame:
    """df and _x, an array of FEATURES: of the suffix the count (thousandths of a bit) and the smoothed share of blocked ones
    (thousandths). own: how many decided URLs, and blocked ones, the row stands for itself."""
    right = F.broadcast(statistics) if few else statistics
    joined = df.withColumn("_s", suffix(F.col("host"))).join(right, F.col("_s") == F.col("_suffix"), "left")
    n, blocked = (F.coalesce(F.col(c), F.lit(0)) - (own[k] if own else F.lit(0)) for k, c in enumerate(("_n", "_blocked")))
    x = [*lexical(F.col(f"`{url}`"), F.col("host"), F.col("path")).values(), F.round(1000 * F.log2(1 + n)).cast("long"), F.round(1000 * (blocked + 1) / (n + 2)).cast("long")]
    return joined.withColumn("_x", F.array(*x)).drop("_s", "_suffix", "_n", "_blocked")


Tree = dict[int, tuple[int, float] | float]  # node: feature and the value above which it goes right, or a leaf's weight


def tree_value(tree: Tree, x: Column, node: int = 1) -> Column:
    at = tree[node]
    if not isinstance(at, tuple):
        return F.lit(float(at))
    return F.when(x[at[0]] > F.lit(at[1]), tree_value(tree, x, 2 * node + 1)).otherwise(tree_value(tree, x, 2 * node))


def node_of(tree: Tree, x: Column, node: int = 1) -> Column:
    at = tree.get(node)
    if at is None:
        return F.lit(node)
    return F.when(x[at[0]] > F.lit(at[1]), node_of(tree, x, 2 * node + 1)).otherwise(node_of(tree, x, 2 * node)) if isinstance(at, tuple) else F.lit(0)


def margin(trees: list[Tree], start: float, x: Column) -> Column:
    total = F.lit(start)
    for t in trees:
        total = total + tree_value(t, x)
    return total


def bin_of(value: Column, cuts: list[int]) -> Column:
    """How many of the cuts the value is over."""
    return F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in cuts]), lambda cut: value > cut))


def fit(train: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> tuple[float, list[Tree]]:
    """Start and trees, by the second-order gain of the logistic loss; train has _x, y (0 or 1) and n (rows alike)."""
    n, positive = train.agg(F.sum("n"), F.sum(F.col("y") * F.col("n"))).first()
    if not n or positive in (0, n):
        return 0.0, []
    start, model = math.log(positive / (n - positive)), []
    cuts = train.agg(*[F.percentile_approx(F.col("_x")[i], [k / bins for k in range(1, bins)], 10_000).alias(f"c{i}") for i in range(len(FEATURES))]).first()
    cuts = [sorted(set(c)) for c in cuts]
    binned = written(train.select("y", "n", F.col("_x"), F.array(*[bin_of(F.col("_x")[i], c) for i, c in enumerate(cuts)]).alias("b")), "url-bins")
    for _ in range(trees):
        tree, p = {}, 1 / (1 + F.exp(-margin(model, start, F.col("_x"))))
        now = binned.select("_x", "b", "n", F.round(SCALE * (p - F.col("y"))).cast("long").alias("g"), F.round(SCALE * p * (1 - p)).cast("long").alias("h"))
        for level in range(depth + 1):
            node = node_of(tree, F.col("_x"))
            hist = now.select(node.alias("node"), "g", "h", "n", F.posexplode("b").alias("f", "bin")).where("node > 0").groupBy("node", "f", "bin").agg(F.sum(F.col("g") * F.col("n")).alias("g"), F.sum(F.col("h") * F.col("n")).alias("h"), F.sum("n").alias("n")).collect()
            for at in sorted({r["node"] for r in hist}):
                tree[at] = best_split([r for r in hist if r["node"] == at], cuts, rate, level == depth)
            if not any(isinstance(v, tuple) for k, v in tree.items() if k >= 1 << level):
                break
        for at in [k for k, v in tree.items() if isinstance(v, tuple)]:
            for child in (2 * at, 2 * at + 1):
                tree.setdefault(child, 0.0)
        model.append(tree)
    return start, model


def best_split(hist: list, cuts: list[list[int]], rate: float, last: bool) -> tuple[int, float] | float:
    """The split of most gain of a node's histogram, or the leaf's weight."""
    first = [r for r in hist if r["f"] == 0]
    g_all, h_all, n_all = (sum(r[k] for r in first) for k in ("g", "h", "n"))
    gain = lambda g, h: (g / SCALE) ** 2 / (h / SCALE + L2)
    best, found = 1e-6, None
    for f in sorted({r["f"] for r in hist}) if not last else []:
        g = h = n = 0
        for r in sorted((r for r in hist if r["f"] == f), key=lambda r: r["bin"]):
            g, h, n = g + r["g"], h + r["h"], n + r["n"]
            if LEAST <= n <= n_all - LEAST and r["bin"] < len(cuts[f]):
                more = gain(g, h) + gain(g_all - g, h_all - h) - gain(g_all, h_all)
                if more > best:
                    best, found = more, (f, cuts[f][r["bin"]])
    return found or -rate * (g_all / SCALE) / (h_all / SCALE + L2)


def url_filter(pages: DataFrame, rules: Rules, url: str = "url", rows: int = TRAIN_ROWS) -> DataFrame:
    """pages, host, path, rule, verdict and p_block (of the trees; null where a rule decides)."""
    mine = ["host", "path", "rule", "verdict", "p_block"]
    kept = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in pages.columns if c not in mine]).alias("row"), F.col(f"`{url}`").cast("string").alias("url"))
    rule, verdict = decided(rules)
    judged = parsed(kept).withColumn("rule", rule).withColumn("verdict", verdict)
    labelled = judged.where("verdict is not null").select("url", "host", "path", "verdict")
    statistics = written(suffix_statistics(labelled), "url-suffixes")
    few = statistics.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES
    sample = labelled.groupBy("url", "host", "path", "verdict").agg(F.count("*").alias("n")).orderBy(F.xxhash64("url"), "url").limit(rows)
    y = (F.col("verdict") == "block").cast("int")
    train = written(featured(sample, statistics, "url", few, (F.col("n"), F.col("n") * y)).select("_x", y.alias("y"), "n"), "url-training")
    start, trees = fit(train)
    score = margin(trees, start, F.col("_x"))
    out = featured(judged, statistics, "url", few).withColumn("p_block", F.when(F.col("verdict").isNull(), 1 / (1 + F.exp(-score))))
    judged = F.coalesce("verdict", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict")
    return out.select(*[F.col(f"row.`{c}`") for c in pages.columns if c not in mine], "host", "path", "rule", judged, "p_block")

"""URL filters (operator 7): rules first, boosted trees on lexical features for the rest; DataFrames only.

Labels are the URLs that a rule decides.  Trees (log-loss, second-order gains, equal-frequency bins) are
grown on a bounded sample of them: at most about ``SAMPLE`` different URLs, drawn by a hash of the URL.
Each level of a tree is one aggregation of gradient sums by leaf, feature and bin; what comes to the
driver is one row for each of those.  A finished tree is a nested CASE expression, so scoring is part of
the scan.  Features: lengths, depth, digit ratio, character entropy, counts of parameters, hyphens, dots
and subdomain labels, and statistics of the host's suffix (its last label): the smoothed share of
blocked URLs and how many labelled URLs have it, counted over all labelled URLs; a URL that teaches
counts itself out.

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged by the trees;
without any labelled URL, or with labels of one kind only, the method's verdict is that kind (allow if
there is none); ports and user names are part of the host as written; rows are judged one by one, so
null ids and repeated rows need no care; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import join_hot, shared_table

SAMPLE, TREES, DEPTH, BINS, RATE, SMOOTH, LEAST = 20_000, 8, 3, 32, 0.5, 1.0, 20
#: Up to so many suffixes (and their figures) go to every executor; beyond it frequent ones only.
FEW_SUFFIXES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query, fixed values: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
FEATURES = ["url_len", "host_len", "path_len", "depth", "digits", "entropy", "params", "hyphens", "dots", "labels", "suffix_rate", "suffix_count"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def lexical(pages: DataFrame) -> DataFrame:
    """Add the lexical features of columns url, host and path, and the host's suffix."""
    url = F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER)
    n = F.greatest(F.length(url), F.lit(1))
    signs = "abcdefghijklmnopqrstuvwxyz0123456789-./:?=&_%#"
    # Shannon entropy over these characters and one class for all others
    shares = [occurrences(url, c) / n for c in signs]
    other = F.length(F.translate(url, signs, "")) / n
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in [*shares, other]), F.lit(0.0))
    digits = (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n
    return pages.withColumns({
        "url_len": F.length(url).cast("double"), "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"),
        "depth": occurrences(F.col("path"), "/").cast("double"), "digits": digits, "entropy": entropy,
        "params": (occurrences(url, "=") + occurrences(url, "&")).cast("double"), "hyphens": occurrences(url, "-").cast("double"),
        "dots": occurrences(F.col("host"), ".").cast("double"), "labels": F.size(F.split("host", r"\.")).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


@dataclass
class Split:
    feature: str
    cut: float
    low: object  # Split or leaf value
    high: object


def as_column(node: object) -> Column:
    """A tree as an expression over the feature columns."""
    if not isinstance(node, Split):
        return F.lit(float(node))
    return F.when(F.col(node.feature) <= node.cut, as_column(node.low)).otherwise(as_column(node.high))


def grow(sample: DataFrame, cuts: dict[str, list[float]], margin: Column) -> Split | float:
    """One tree for the current margins: level by level, from sums of gradients by leaf, feature and bin."""
    p = 1 / (1 + F.exp(-margin))
    base = sample.select(*FEATURES, (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
    bins = {f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in FEATURES}
    paths: dict[int, tuple[int, str, float]] = {}  # leaf -> split that it became
    leaves, values = [1], {}
    leaf: Column = F.lit(1)
    for level in range(DEPTH + 1):
        # one row for each leaf, feature and bin that occurs
        long = base.select(leaf.alias("leaf"), "g", "h", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), bins[f].alias("b")) for i, f in enumerate(FEATURES)))).alias("x"))
        rows = long.groupBy("leaf", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
        sums: dict[tuple[int, int], dict[int, tuple[float, float, int]]] = {}
        for r in rows:
            sums.setdefault((r["leaf"], r["f"]), {})[r["b"]] = (r["g"], r["h"], r["n"])
        split: dict[int, tuple[int, int]] = {}
        for node in leaves:
            found = sums.get((node, 0), {})
            g, h, n = (sum(x[i] for x in found.values()) for i in range(3))
            values[node] = -g / (h + SMOOTH)
            best = 1e-6
            for i, f in enumerate(FEATURES) if level < DEPTH else ():
                gl = hl = nl = 0
                for b in range(len(cuts[f])):
                    x = sums.get((node, i), {}).get(b, (0, 0, 0))
                    gl, hl, nl = gl + x[0], hl + x[1], nl + x[2]
                    if nl < LEAST or n - nl < LEAST:
                        continue
                    gain = gl * gl / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH) - g * g / (h + SMOOTH)
                    if gain > best * (1 + 1e-9):
                        best, split[node] = gain, (i, b)
        if not split:
            break
        leaf_next, leaves = leaf, []
        for node, (i, b) in split.items():
            f, cut = FEATURES[i], cuts[FEATURES[i]][b]
            paths[node] = (i, f, cut)
            leaf_next = F.when(leaf == node, F.when(F.col(f) <= cut, 2 * node).otherwise(2 * node + 1)).otherwise(leaf_next)
            leaves += [2 * node, 2 * node + 1]
        base = base.withColumn("_leaf", leaf_next)
        leaf = F.col("_leaf")

    def build(node: int) -> Split | float:
        if node not in paths:
            return RATE * values[node]
        _, f, cut = paths[node]
        return Split(f, cut, build(2 * node), build(2 * node + 1))

    return build(1)


def train(labelled: DataFrame) -> Column:
    """The margin of blocking (log-odds) as an expression; ``labelled`` has y and all features."""
    sample = labelled.select("y", *FEATURES).cache()
    n, blocked = sample.agg(F.count("*"), F.sum("y")).first()
    if not n or blocked in (0, n):
        return F.lit(-1.0 if not n or not blocked else 1.0)
    steps = [i / BINS for i in range(1, BINS)]
    found = sample.select(*(F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(found[f])) for f in FEATURES}
    margin: Column = F.lit(math.log((blocked + 1) / (n - blocked + 1)))
    for _ in range(TREES):
        tree = grow(sample, cuts, margin)
        if not isinstance(tree, Split):
            break
        margin = margin + as_column(tree)
    sample.unpersist()
    return margin


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(id_col, host, path, rule, verdict, score): score is the trees' probability of blocking."""
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    src = src.withColumns({"host": host, "path": path})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = src.withColumns({"rule": rule, "ruled": verdict})
    known = ruled.where("ruled is not null").select("url", "host", "path", F.when(F.col("ruled") == "block", 1.0).otherwise(0.0).alias("y")).distinct()
    size = known.count()
    steps = 1 << 20
    drawn = known.where(F.pmod(F.xxhash64("url", F.lit(11)), F.lit(steps)) < math.ceil(sample * steps / max(size, 1)))
    # suffix statistics of all labelled URLs, one row for each suffix
    suffix = F.substring_index("host", ".", -1).alias("suffix")
    suffixes = shared_table(known.select(suffix, "y").groupBy("suffix").agg(F.sum("y").alias("blocked"), F.count("*").alias("n")))
    few = suffixes.count() <= FEW_SUFFIXES
    told = suffixes.select("suffix", ((F.col("blocked") + 1) / (F.col("n") + 2)).alias("suffix_rate"), F.log1p("n").alias("suffix_count"), "n")
    # a URL that teaches is left out of its own suffix's figures
    own = lexical(drawn).join(F.broadcast(suffixes) if few else suffixes, "suffix")
    own = own.withColumns({"suffix_rate": (F.col("blocked") - F.col("y") + 1) / (F.col("n") + 1), "suffix_count": F.log1p(F.col("n") - 1)})
    margin = train(own.select("y", *FEATURES))
    rows = lexical(ruled)
    if few:
        scored = rows.join(F.broadcast(told.drop("n")), "suffix", "left")
    else:  # suffixes that no label has meet nothing
        every = rows.groupBy("suffix").agg(F.count("*").alias("n")).join(told.drop("n"), "suffix", "left")
        scored = join_hot(rows, shared_table(every), "suffix").drop("n")
    scored = scored.fillna({"suffix_rate": 0.5, "suffix_count": 0.0})
    score = 1 / (1 + F.exp(-margin))
    out = scored.withColumn("score", score)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")

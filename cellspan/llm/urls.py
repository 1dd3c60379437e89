"""URL filter: stated rules first, then association rules mined from labelled urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

# The stated rules (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
BAD = "<bad>"

#: Rows that a mined rule must have at least, and how much likelier than on average it must make the label.
MIN_ROWS, MIN_LIFT = 20, 1.5


def host_path(url: str) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z in lower case) and path (then up to ``? #``); else both empty."""
    at = f"instr(`{url}`, '://')"
    rest = f"if({at} > 0, substring(`{url}`, {at} + 3), '')"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{upper}', '{upper.lower()}')"
    path = f"regexp_extract({rest}, '^[^/?#]*(/[^?#]*)?', 1)"
    return F.expr(f"coalesce({host}, '')"), F.expr(f"coalesce({path}, '')")


def stated_rule(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits ``host`` or a domain it is under, and the start of ``path``."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        host, path = r[: r.index("/")], r[r.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: str) -> Column:
    """Distinct tokens of a url: scheme, domains, path segments (runs of digits as #), extension, query, fragment."""
    host, path = host_path(url)
    u = f"coalesce(`{url}`, '')"
    query = F.expr(rf"regexp_extract({u}, r'\?([^#]*)', 1)")
    parts = F.split(F.regexp_replace(path, r"\d+", "#"), "/")
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    tag = lambda name, c: F.when(c != "", F.concat(F.lit(name), c))
    one = F.array(
        tag("scheme:", F.expr(f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)")),
        tag("ext:", F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
        tag("fragment:", F.expr(rf"regexp_extract({u}, r'#(.*)', 1)")),
        F.when(path.endswith("/"), F.lit("slash")),
    )
    segments = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    queries = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.split(x, "=")[0]))
    return F.array_distinct(F.filter(F.concat(one, domains, segments, queries), lambda x: x.isNotNull()))


def mine(
    labelled: DataFrame,
    min_support: float = 0.002,
    min_confidence: float = 0.8,
    min_rows: int = MIN_ROWS,
    min_lift: float = MIN_LIFT,
    url_col: str = "url",
    bad_col: str = "bad",
) -> DataFrame:
    """``(rule_id, tokens, n, confidence, support, lift)``: token sets that imply the label ``bad``, by FP-growth.

    ``labelled`` has a url and a boolean; all its rows with a label are mined. A rule's tokens and the label occur
    together in ``min_support`` of the rows and in ``min_rows`` of them at least, so that no single urls are learnt by
    heart; ``min_confidence`` of the rows with the tokens are bad, and that is ``min_lift`` times the share of all rows.
    Rules that contain another of the same confidence or more are pruned. A table without bad rows has no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    items = F.when(F.col(bad_col), F.concat(tokens(url_col), F.array(F.lit(BAD)))).otherwise(tokens(url_col))
    baskets = cut(labelled.where(F.col(bad_col).isNotNull()).select(items.alias("items")))
    n, bad = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    if bad < max(1, min_rows):
        return labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, n int, confidence double, support double, lift double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_rows - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where((F.size("antecedent") > 0) & (F.col("lift") >= min_lift))
    rules = cut(rules.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support", "lift"))
    # A rule is dominated if a proper subset implies the label as surely: subsets share their first token, among others.
    r = rules.select(F.explode("tokens").alias("first"), "tokens", "confidence")
    s = rules.select(F.col("tokens")[0].alias("first"), F.col("tokens").alias("t"), F.col("confidence").alias("c"))
    dominated = r.join(s, "first").where(
        (F.size("t") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("t", "tokens")) == 0)
    )
    kept = rules.join(dominated.select("tokens").distinct(), "tokens", "left_anti")
    return cut(kept.select(F.xxhash64("tokens").alias("rule_id"), "tokens", F.size("tokens").alias("n"), "confidence", "support", "lift"))


def judge(pages: DataFrame, rules: DataFrame, stated=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row; ``rules`` as ``mine`` gives them.

    The longest stated rule decides; else a url is blocked if it has all tokens of a mined rule. Mined rules are matched
    by an inverted index: distinct token sets meet it by token, and a rule that is met as often as it has tokens fits. Null
    urls have an empty host and path and are allowed. Rows that repeat stay.
    """
    host, path = host_path(url_col)
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), tokens(url_col).alias("tokens"))
    rule, verdict = stated_rule(stated)
    base = base.withColumn("rule", rule).withColumn("stated", verdict)
    decided = F.coalesce("stated", F.lit("allow")).alias("verdict")
    if rules.isEmpty():
        return base.select("id", "host", "path", "rule", decided)
    open_ = base.where("stated is null")
    index = rules.select(F.explode("tokens").alias("token"), "rule_id", "n")
    met = open_.select("tokens").distinct().withColumn("token", F.explode("tokens")).join(maybe_broadcast(index), "token")
    fits = met.groupBy("tokens", "rule_id", "n").agg(F.count("*").alias("m")).where("m = n")
    blocked = cut(fits.select("tokens").distinct().withColumn("mined", F.lit("block")))
    mined = open_.join(maybe_broadcast(blocked), "tokens", "left").select("id", "host", "path", "rule", F.coalesce("mined", F.lit("allow")).alias("verdict"))
    return base.where("stated is not null").select("id", "host", "path", "rule", decided).union(mined)

"""URL filters: fixed rules first, then association rules mined from labelled pages.

* **Fixed rules** (verdict, host, path) fit their host and its subdomains where
  the url's path starts with the rule's; the longest fitting rule decides.
* **Labels** (``labelled``).  A url that a fixed rule fits is bad or good by that
  rule's verdict; another one takes the given label of its page, if there is one.
* **Mined rules.**  A labelled url is a transaction of its tokens (top-level
  domain, site, subdomain, host words, directories, extension, query names,
  fragment) and its label.  Spark's FP-growth finds token combinations that
  often come with a bad label.  Kept are the rules with enough bad
  urls (a number, not a share of the table) and confidence, whose lower (Wilson)
  bound is above the share of bad urls of the table, and whose confidence no rule on fewer of their tokens reaches.
  A rule must also hold where no surer one matches: one whose confidence is only
  that of a narrower rule's urls goes (database coverage, repeated until none goes).
* **Inverted index.**  A row for each rule, under its rarest token.  The tokens
  of the distinct urls' distinct token sets join it; a rule matches where the set
  holds all of its tokens.  A url that a mined rule matches is blocked.

A hot host or url is reduced to distinct urls before tokens are dealt; mined
rules are joined, not collected.

Defined cases: a null url, or one without ``://``: empty host and path, no
tokens, allowed unless labelled tokens say otherwise (there are none).  A null
page id is carried and has no given label; of several labels of a page one bad
one suffices.  Urls of any length are read whole.  Without bad labels nothing is
mined.  Repeated rows each get their result; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstice.llm.graph import stored

#: Least number of labelled urls, at every size, that hold a rule's tokens and a bad label; least share of bad ones among
#: those with its tokens; normal quantile of the bound that this share must hold against the share of all urls.
MIN_URLS, MIN_CONFIDENCE, QUANTILE = 20, 0.6, 1.96
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, host, path) rules that fits; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url; numbers are left out, they name single pages."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    tagged = lambda tag, xs: F.transform(F.filter(xs, lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), lambda x: F.concat(F.lit(tag + "="), x))
    dirs = F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/")
    last = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.split(F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), r"=[^&]*", ""), "&")
    every = F.concat(
        tagged("tld", F.slice(labels, -1, 1)), tagged("site", F.array(F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), "."))),
        tagged("word", F.filter(F.split(host, "[.-]"), lambda x: F.length(x) > 3)),
        tagged("dir", dirs), tagged("ext", F.array(last)), tagged("query", query), tagged("fragment", F.array(F.regexp_extract(url, r"(?s)#(.*)$", 1))))
    return F.when(host != "", F.array_distinct(F.when(n > 0, every).otherwise(tagged("dir", dirs)))).otherwise(F.array().cast("array<string>"))


def labelled(pages: DataFrame, fixed: Sequence[tuple[str, str, str]], given: DataFrame, id_col: str = "page_id", url_col: str = "url",
             bad_col: str = "bad") -> DataFrame:
    """id, url, bad of the pages with a known answer: the verdict of the fixed rule that fits, else ``given``'s label (id, bad)."""
    _, verdict = fitting_rule(host_of(F.col(url_col)), path_of(F.col(url_col)), fixed)
    one = given.groupBy(F.col(id_col).alias("_id")).agg(F.max(bad_col).alias("_given"))
    rows = pages.select(id_col, url_col).join(one, F.col(id_col) == F.col("_id"), "left")
    known = F.when(verdict.isNotNull(), verdict == "block").otherwise(F.col("_given"))
    return rows.select(id_col, url_col, known.alias(bad_col)).filter(F.col(bad_col).isNotNull())


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad",
         support: float = 0.0, confidence: float = MIN_CONFIDENCE, urls: int = MIN_URLS) -> DataFrame:
    """rule (number), tokens, support, confidence of the mined rules; ``bad_col`` is a boolean."""
    spark = labelled.sparkSession
    schema = "rule long, tokens array<string>, support double, confidence double"
    items = labelled.filter(F.col(bad_col).isNotNull()).select(F.concat(
        F.coalesce(tokens_of(F.col(url_col)), F.array().cast("array<string>")),
        F.when(F.col(bad_col), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    items = stored(items.filter(F.size("items") > 0), "urls")
    if items.filter(F.array_contains("items", BAD)).isEmpty():
        return spark.createDataFrame([], schema)
    n, bad = items.agg(F.count(F.lit(1)), F.count(F.when(F.array_contains("items", BAD), 1))).first()
    least = min(1.0, max(support, (urls - 0.5) / n))  # a few bad urls prove nothing; the half keeps rounding from asking for one more
    found = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(items).associationRules
    # Wilson's lower bound of a rule's share of bad urls, of as many as hold its tokens.
    share, held, z2 = F.col("confidence"), F.col("support") * n / F.col("confidence"), QUANTILE ** 2
    sure = (share + z2 / (2 * held) - QUANTILE * F.sqrt(share * (1 - share) / held + z2 / (4 * held * held))) / (1 + z2 / held)
    rules = found.filter((F.col("consequent")[0] == BAD) & (sure > F.lit(bad / n))).select(F.array_sort("antecedent").alias("tokens"), "support", "confidence")
    rules = stored(rules.withColumn("rule", F.xxhash64("tokens")).select("rule", "tokens", "support", "confidence"), "rules")
    # A rule goes when another one on a proper part of its tokens is as sure.
    # Its parts are spelled out (FP-growth's sets have ten tokens at most) and looked up whole: rules that share a common token don't meet.
    covered = _parts(rules).join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("_sure")), "part").filter(F.col("_sure") >= F.col("confidence"))
    return _holding(stored(rules.join(covered.select("rule").distinct(), "rule", "left_anti"), "rules"), items, confidence)


def _parts(rules: DataFrame) -> DataFrame:
    """rule, confidence, part: every proper part of a rule's sorted tokens but the empty one."""
    every = F.expr("transform(sequence(1, shiftleft(1, size(tokens)) - 2), m -> filter(tokens, (x, i) -> (shiftright(m, i) & 1) = 1))")
    return rules.filter(F.size("tokens") > 1).select("rule", "confidence", F.explode(every).alias("part"))


def _hits(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The columns of each row of ``sets`` beside each rule (and confidence) whose tokens its ``items`` all hold.

    A rule has one posting, under the token that the fewest sets hold, and is compared whole there: sets and rules that
    share a common token alone don't meet.
    """
    terms = sets.select(F.explode("items").alias("token"), F.struct(*sets.columns).alias("s"))
    often = terms.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    posted = (rules.select("rule", F.explode("tokens").alias("token")).join(often, "token", "left")
              .groupBy("rule").agg(F.min(F.struct(F.coalesce("often", F.lit(0)), "token")).alias("least")).select("rule", "least.token"))
    met = terms.join(rules.select("rule", "tokens", "confidence").join(posted, "rule"), "token")
    return met.filter(F.size(F.array_except("tokens", "s.items")) == 0).select("s.*", "rule", "confidence")


def _holding(rules: DataFrame, items: DataFrame, confidence: float) -> DataFrame:
    """Rules whose share of bad urls is ``confidence`` or more among the labelled urls that no surer rule matches (or that have none)."""
    # Equal token sets are one row with a number, written before its tokens are dealt.
    sets = stored(items.groupBy("items").agg(F.count(F.lit(1)).alias("n")).withColumn("set", F.monotonically_increasing_id()), "sets")
    sets = sets.select("set", "n", F.array_contains("items", BAD).alias("bad"), "items")
    while True:
        first = _hits(sets, rules).groupBy("set", "n", "bad").agg(F.max_by("rule", F.struct("confidence", -F.col("rule"))).alias("rule"))
        fails = stored(first.groupBy("rule").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"))
                       .filter(F.col("b") < confidence * F.col("n")).select("rule"), "fails")
        if fails.isEmpty():
            return rules
        rules = stored(rules.join(fails, "rule", "left_anti"), "rules")


def matched(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """url, mined_rule: the surest rule (then the smallest number) that matches each distinct url that has one."""
    # Urls of equal tokens are one set.
    terms = urls.select(F.col(url_col).alias("u")).filter("u is not null").distinct().select("u", F.array_sort(tokens_of(F.col("u"))).alias("items"))
    best = _hits(terms.select("items").distinct(), rules).groupBy("items").agg(F.max_by("rule", F.struct("confidence", -F.col("rule"))).alias("mined_rule"))
    return terms.join(best, "items").select(F.col("u").alias(url_col), "mined_rule")


def judge(pages: DataFrame, fixed: Sequence[tuple[str, str, str]], mined: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, mined_rule of every row."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = base.join(matched(base, mined, "url"), "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), fixed)
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return (rows.select("id", host.alias("host"), path.alias("path"), "mined_rule")
            .select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mined_rule"))

"""URL filtering by host and path rules, and by association rules mined with Spark's FP-growth.

Listed rules come first: a rule fits its host and all subdomains if the url's path starts with the rule's, the longest
rule wins. Other urls are judged by mined rules: labelled urls become sets of tokens (suffixes of the host, the words of
its labels, path segments, query keys) with an item for a bad label; FP-growth finds frequent combinations, and rules
from tokens to the bad label are kept by support, confidence and lift. Tokens that the very same labelled urls hold
stand for each other, so only the one of most urls is mined, and a rule goes if another one with fewer of its tokens is
as confident. Rules are met through an inverted index: each is listed under its rarest token, urls' tokens are joined
with the index, and the rule's other tokens are checked on meeting. Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callatlas.llm.common import materialize, salted_left_join

#: Rules as text: host, then path; allow or block.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Listed rules that are tested one by one on every url; more are joined by their hosts.
PLAIN_RULES = 500
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.6, 1.2
#: Labelled urls that a mined rule needs.
MIN_URLS = 10
#: Urls with a verdict by join that are broadcast at most; more are joined by shuffling, with salts.
BROADCAST_URLS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BAD = "label=block"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """All ends of a host at its dots, the whole last."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def _listed(rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits; equally long ones: the first as a string."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, kind in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the longest is tested first
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _listed_by_host(base: DataFrame, rules) -> DataFrame:
    """base with rule and listed as _listed() gives them, by an equality join of host suffixes with the rules' hosts."""
    rows = [(text.partition("/")[0], "/" + text.partition("/")[2] if "/" in text else "", text, kind) for text, kind in rules]
    table = base.sparkSession.createDataFrame(rows, "name string, start string, rule string, listed string")
    urls = base.where("host <> ''").select("url", "host", "path").distinct()
    met = urls.select("url", "path", F.explode(_suffixes(F.col("host"))).alias("name")).join(table, "name").where(F.expr("startswith(path, start)"))
    order = F.struct(F.length("rule").alias("n"), F.transform(F.split("rule", ""), lambda c: -F.ascii(c)).alias("first"))
    best = met.groupBy("url").agg(F.max_by(F.struct("rule", "listed"), order).alias("r")).select("url", "r.rule", "r.listed")
    return _with_urls(base, best)


def _with_urls(base: DataFrame, found: DataFrame) -> DataFrame:
    """base with the columns of `found`, which holds a row for some urls."""
    found = materialize(found, "urls-found")
    return base.join(F.broadcast(found), "url", "left") if found.count() <= BROADCAST_URLS else salted_left_join(base, found, ["url"])


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url; empty for urls without a host."""
    kind = lambda name, column: F.transform(F.filter(column, lambda s: s != ""), lambda s: F.concat(F.lit(f"{name}="), s))
    after = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(after, "&"), lambda s: s != ""), lambda s: F.substring_index(s, "=", 1))
    parts = [kind("host", _suffixes(host)), kind("word", F.split(host, r"[.\-]")), kind("path", F.split(path, r"[/.]")), kind("key", keys)]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*parts)))


def mine(labelled: DataFrame, urls: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """antecedent (tokens, sorted), confidence, lift, support of the rules to the bad label, from rows (tokens, bad).

    Tokens that are too rare, or too rarely bad, for any rule are left out before mining. Tokens of the same rows are
    one: that which most of `urls` (rows with tokens; default: the labelled ones) hold, or the first of these. Without
    rows, or without bad ones, there are no rules.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "antecedent array<string>, confidence double, lift double, support double")
    n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if not n or not bad:
        return none
    least = max(MIN_URLS, min_support * n)
    spread = materialize(labelled.withColumn("row", F.monotonically_increasing_id()).select("row", "bad", F.explode("tokens").alias("token")), "url-tokens")
    same = [F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows_a"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("rows_b")]  # equal for equal sets of rows
    common = spread.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), *same)
    # at most 1 / min_support tokens per token of a url, so this table is bounded however large the others are
    common = materialize(common.where((F.col("n") >= least) & (F.col("n_bad") >= least * min_confidence) & (F.col("n") <= 0.95 * n)), "common-tokens")
    if common.isEmpty():
        return none
    if urls is not None:
        wide = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(common.select("token")), "token").groupBy("token").agg(F.count("*").alias("wide"))
        common = common.join(wide, "token", "left").withColumn("wide", F.coalesce("wide", F.lit(0)))
    else:
        common = common.withColumn("wide", F.lit(0))
    useful = common.groupBy("rows_a", "rows_b", "n").agg(F.min(F.struct((-F.col("wide")).alias("w"), "token"))["token"].alias("token")).select("token")
    baskets = spread.join(F.broadcast(useful), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("items"))  # a url's tokens
    baskets = materialize(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least * min_confidence / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1) == _BAD)
    share = F.lit(bad / n)
    # a lower bound on the confidence, by the normal approximation: few urls don't make a rule
    seen = F.col("support") * baskets.count() / F.col("confidence")
    bound = F.col("confidence") - 1.64 * F.sqrt(F.col("confidence") * (1 - F.col("confidence")) / seen)
    rules = rules.where((seen >= least - 1e-6) & (F.col("confidence") / share >= min_lift) & (bound >= 0.5))
    return prune(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("confidence") / share).alias("lift"), "support"))


def index_of(rules: DataFrame) -> DataFrame:
    """antecedent, confidence and `token`, the rarest of the antecedent among the rules."""
    rarity = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    spread = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(rarity, "token")
    return spread.groupBy("antecedent", "confidence").agg(F.min(F.struct("n", "token"))["token"].alias("token"))


def prune(rules: DataFrame) -> DataFrame:
    """The rules without those that hold all tokens of a shorter one of at least their confidence."""
    rules = materialize(rules, "rules")
    index = index_of(rules).select("token", F.col("antecedent").alias("less"), F.col("confidence").alias("sure"))
    wide = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(index, "token")
    idle = wide.where((F.size("less") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "antecedent")) == 0))
    return rules.join(idle.select("antecedent").distinct(), "antecedent", "left_anti").select(*rules.columns)


def met_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and `mined`, the confidence of the best rule whose tokens the url (with tokens) has all; others have no row."""
    keyed = urls.select("url", "tokens").dropDuplicates(["url"]).select("url", "tokens", F.explode("tokens").alias("token"))
    hits = keyed.join(index_of(rules), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and, where mined rules met the url, the confidence of the best as `mined`.

    `labels` holds page_id and bad (boolean); a page of several labels is bad if one says so, null ones say nothing. One
    row per row of pages; null urls and urls without `://` have an empty host and path, fit no rule and are allowed;
    ties and repeated rows give equal verdicts; other columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) <= PLAIN_RULES:
        rule, verdict = _listed(rules)
        base = base.withColumn("rule", rule).withColumn("listed", verdict)
    else:
        base = _listed_by_host(base, rules)
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    given = labels.where("bad is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").alias("bad"))
    known = materialize(base.select("page_id", tokens).join(given, "page_id").select("tokens", "bad").where("size(tokens) > 0"), "known-urls")
    mined = materialize(mine(known, base.select(tokens)), "mined-rules")
    if mined.isEmpty():
        judged = base.withColumn("mined", F.lit(None).cast("double"))
    else:
        judged = _with_urls(base, met_rules(base.where("listed is null").select("url", tokens), mined)).withColumn("mined", F.when(F.col("listed").isNull(), F.col("mined")))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined")

"""URL filter by association rules of URL tokens.

Tokens of a URL are its scheme, the labels of its host with their place, the words of its path and
the names of its query parameters. A page shows the document whose number ends its path, and has
that document's label. FP-growth over the token sets of labelled pages (a page is bad if its label
says toxic or of low quality) finds frequent combinations. Tokens that stand on the same labelled pages
(the words of one url template) are one item of it: a combination with one of them is as frequent as that with
any other of them or with several, so nothing is lost and they do not multiply. Those that come with the bad mark in at
least ``confidence`` of their pages, and in ``least`` pages, become rules if that is no coincidence: the
chance of so many bad pages at the base rate, times the number of combinations looked at, is at most
CHANCE. A rule is dropped where one with fewer tokens of it is at least as confident. A page is blocked if it holds all tokens of a rule. Rules
are found by an inverted index from their rarest token. Fixed rules on (host, path) come first: a
rule fits its host and all subdomains when the path starts with the rule's path; the longest wins.

Null URLs and those without ``://`` have an empty host and path, match no rule and are allowed unless
the rules learned say otherwise of their (empty) token set. Pages whose path ends in no number have no
label. Repeated rows each get their row. Without labels there are no learned rules.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import partial

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path)
FIXED_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
SUPPORT = 0.002
CONFIDENCE = 0.7
LEAST = 10  # bad pages of a rule, whatever the share
CHANCE = 0.01  # that any rule is found among labels without a bearing on URLs
MAX_RULE_BYTES = 64 << 20  # what is sent to the tasks
BAD = "\u0001bad"
# A-Z and a-z of ASCII, for lower-casing hosts by these letters only
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """(host, path) columns; empty for null and for URLs without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    # the first "://" is the shortest prefix
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def fixed_rule(host, path, rules=FIXED_RULES):
    """(rule, verdict) of the longest fixed rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens(url):
    """Distinct tokens of a URL."""
    host, path = url_parts(url)
    text = F.coalesce(url, F.lit(""))
    scheme = F.concat(F.lit("s:"), F.lower(F.regexp_extract(text, r"(?s)^(.*?)://", 1)))
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\d+", "0")))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=", 2)[0]))
    return F.array_distinct(F.concat(F.array(scheme), labels, words, names))


class Rules:
    """Learned rules with their inverted index: from a token to the rules of which it is the rarest."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float, float]], frequency: dict[str, float], items: dict[str, str] | None = None):
        self.rules = rules
        self.items = items or {}  # the item of each token of a rule
        self.index: dict[str, list[frozenset[str]]] = defaultdict(list)
        for tokens_, _, _ in rules:
            self.index[min(tokens_, key=lambda t: (frequency.get(t, 0), t))].append(frozenset(tokens_))

    def blocks(self, have: set[str]) -> bool:
        have = {self.items.get(t, t) for t in have}
        return any(rule <= have for t in have if t in self.index for rule in self.index[t])


def document_number(url):
    """The number that ends the path, null without one: /en/12, /en/12/ and /en/12.html."""
    _, path = url_parts(url)
    return F.regexp_extract(path, r"/([0-9]+)(?:\.[A-Za-z0-9]+)?/?$", 1).try_cast("bigint")


def chance_of(bad: int, of: int, base: float) -> float:
    """An upper bound (Chernoff) of the chance of at least ``bad`` of ``of`` pages at the base rate."""
    share = bad / of
    if share <= base or base <= 0:
        return 1.0
    rest = (1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0
    return math.exp(-of * (share * math.log(share / base) + rest))


def items_of(sets: DataFrame, least: float) -> DataFrame:
    """(token, item): the item of each token on at least ``least`` rows of sets (t): the first of those on the same rows."""
    names = [F.xxhash64("t", F.lit(i)).alias(f"x{i}") for i in (1, 2)]
    distinct = sets.groupBy("t").agg(F.count("*").alias("n")).select(F.explode("t").alias("token"), "n", *names)
    of = distinct.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    of = of.filter(F.col("n") >= least)
    first = of.groupBy("n", "x1", "x2").agg(F.min("token").alias("item"))
    return of.join(first, ["n", "x1", "x2"]).select("token", "item")


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> Rules:
    """Rules from pages whose document has a label. labels: (doc_id, quality, toxic)."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(bad).alias("bad")).filter("bad is not null and _id is not null")
    sets = pages.select(document_number(F.col("url")).alias("_id"), tokens(F.col("url")).alias("t")).join(marks, "_id")
    sets = sets.select(F.array_sort("t").alias("t"), "bad").persist()
    n, n_bad = sets.agg(F.count("*"), F.count_if(F.col("bad") == 1)).first()
    if n_bad < least:
        sets.unpersist()
        return Rules([], {})
    least_share = max(support, least / n)
    named = items_of(sets, least_share * n * (1 - 1e-9)).persist()
    folded = sets.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode("t")).join(named, "token")
    folded = folded.groupBy("row").agg(F.collect_set("item").alias("items"), F.first("bad").alias("bad"))
    baskets = folded.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")).persist()
    in_baskets = baskets.count()  # pages without any frequent token are in none
    if not in_baskets:
        return Rules([], {})
    share = min(1.0, least_share * n * (1 - 1e-9) / in_baskets)
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    frequent = model.freqItemsets.select("items", "freq").persist()
    with_bad = frequent.filter(F.array_contains("items", BAD) & (F.size("items") > 1))
    with_bad = with_bad.select(F.array_sort(F.array_remove("items", BAD)).alias("rule"), F.col("freq").alias("bad_freq"))
    all_ = frequent.filter(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("rule"), "freq")
    found = with_bad.join(all_, "rule").withColumn("conf", F.col("bad_freq") / F.col("freq")).filter((F.col("conf") >= confidence) & (F.col("bad_freq") >= least))
    looked_at = all_.count()
    rules, size = [], 0
    for r in found.toLocalIterator():
        if looked_at * chance_of(r["bad_freq"], r["freq"], n_bad / n) > CHANCE:
            continue
        rules.append((tuple(r["rule"]), r["conf"], r["bad_freq"]))
        size += sum(len(t) for t in r["rule"]) + 64
        if size > MAX_RULE_BYTES:
            raise ValueError("too many rules to send to the tasks: raise support or confidence")
    single = {r["items"][0]: r["freq"] for r in frequent.filter(F.size("items") == 1).toLocalIterator()}
    used = sorted({t for rule, _, _ in rules for t in rule})
    items = {}
    for r in named.filter(F.col("item").isin(used) & (F.col("item") != F.col("token"))).toLocalIterator():
        items[r["token"]] = r["item"]
        size += len(r["token"]) + len(r["item"]) + 64
        if size > MAX_RULE_BYTES:
            raise ValueError("too many rules to send to the tasks: raise support or confidence")
    for held in (sets, named, baskets, frequent):
        held.unpersist()
    rules.sort(key=lambda r: (len(r[0]), r[0]))
    kept: list[tuple[tuple[str, ...], float, float]] = []
    best: dict[frozenset[str], float] = {}
    for rule, conf, freq in rules:
        have = frozenset(rule)
        if any(best.get(have - {t}, -1) >= conf for t in have):
            best[have] = max(best[have - {t}] for t in have if have - {t} in best)
            continue
        best[have] = conf
        kept.append((rule, conf, freq))
    return Rules(kept, single, items)


def _match_batches(batches, rules: Rules):
    for batch in batches:
        blocked = [rules.blocks(set(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(blocked, pa.bool_())], [*batch.schema.names[:-1], "blocked"])


def judge(pages: DataFrame, rules: Rules, fixed=FIXED_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, learned) of each page."""
    host, path = url_parts(F.col("url"))
    work = pages.select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("t"))
    schema = work.drop("t").schema.add("blocked", "boolean")
    out = work.mapInArrow(partial(_match_batches, rules=rules), schema)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    learned = F.when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), learned.alias("learned"))

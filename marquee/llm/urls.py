"""Op 5, URL filter (DataFrame functions only): host and path rules, then empirical-Bayes host reputation.

The reputation of a host is the posterior chance that a page of it is good.  Labelled pages are counted by host;
the beta prior of a host is centred on the rate of the other hosts of its registered domain, which is shrunk towards
that of the other domains of its suffix, and that towards the rate of all other suffixes: each page counts once.  The
weight of each prior is estimated from the spread between siblings (method of moments).  A page goes when even the
upper posterior bound of its host's rate lies below what is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Fixed: second labels that belong to the suffix below a country's label of two letters.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
LEAST_RATE, DEVIATIONS = 0.5, 1.64


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what lies between the first :// and the next / ? # (A-Z lower-cased), then up to ? or #.

    Both are empty for null and for a url without ://.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule (host and path together; on a tie the longer host, then block) that fits, else nulls.

    A rule fits its host and its subdomains, where the path starts with the rule's.  ``rules`` is a short list.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, says in reversed(ranked):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def levels(host: Column) -> dict[str, Column]:
    """Registered domain and suffix of a host, without its port and last full stops.

    The suffix is the last label, or two of them where the second is one of SECOND below a country's; the domain has
    one label more.  A numeric address is its own domain, of the suffix 'ip'.
    """
    bare = F.regexp_replace(host, "\\.*(?::[0-9]*)?$", "")
    address = bare.rlike("^(?:[0-9]+(?:\\.[0-9]+){3}|\\[.*)$")
    wide = bare.rlike(f"\\.(?:{'|'.join(SECOND)})\\.[a-z]{{2}}$")
    last = lambda n: F.substring_index(bare, ".", -n)
    return {"host": host, "domain": F.when(address, bare).when(wide, last(3)).otherwise(last(2)), "suffix": F.when(address, "ip").when(wide, last(2)).otherwise(last(1))}


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, good, mean, low, high of every host of ``outcomes``: host and label (1 good, 0 bad, null unlabelled).

    Hosts without labels have their prior's mean.  Rows are summed before they are shuffled, so a host with a third of
    all rows is one row a task.  Three weights and the sums of all are brought to the driver.
    """
    with Scratch(outcomes.sparkSession) as scratch:
        sums = outcomes.groupBy("host").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("double").alias("good"))
        hosts = scratch.save(sums.select("*", *[c.alias(k) for k, c in levels(F.col("host")).items() if k != "host"]), "hosts", keep=True)
    total = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = total(hosts, "suffix", "domain")
    suffixes = total(domains, "suffix")
    all_ = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good")).first()
    # a suffix's prior: all other suffixes, and a uniform prior above them
    suffixes = suffixes.withColumn("up", (F.lit(all_["good"]) - F.col("good") + 1) / (F.lit(all_["n"]) - F.col("n") + 2))
    domains = _others(domains, suffixes, "suffix", _weight(suffixes))
    hosts = _others(hosts, domains, "domain", _weight(domains))
    weight = _weight(hosts)
    hosts = hosts.withColumn("mean", (F.col("good") + weight * F.col("up")) / (F.col("n") + weight))
    spread = DEVIATIONS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + F.col("n") + 1))
    return hosts.select("host", "n", "good", "mean", F.greatest(F.lit(0.0), F.col("mean") - spread).alias("low"), F.least(F.lit(1.0), F.col("mean") + spread).alias("high"))


def _others(rows: DataFrame, parents: DataFrame, key: str, weight: float) -> DataFrame:
    """Adds up to rows of n and good: the rate of their siblings, all of the parent but themselves, shrunk towards the parent's own up."""
    of = parents.select(key, F.col("n").alias("of_n"), F.col("good").alias("of_good"), F.col("up").alias("of_up"))
    up = (F.col("of_good") - F.col("good") + weight * F.col("of_up")) / (F.col("of_n") - F.col("n") + weight)
    return rows.join(of, key).withColumn("up", up).drop("of_n", "of_good", "of_up")


def _weight(rows: DataFrame) -> float:
    """Weight, in pages, of the prior of rows with n, good and up, the prior mean.

    Under a beta prior of weight w, (good - n up)^2 / (up (1 - up)) has mean n + n (n - 1) / (w + 1): w + 1 is solved
    from the sums over all rows, and w kept within 1 and 1000.
    """
    p, n = F.col("up"), F.col("n")
    seen = rows.filter("n > 0").agg(
        F.sum((F.col("good") - n * p) ** 2 / F.greatest(p * (1 - p), F.lit(1e-6))).alias("seen"), F.sum(n).alias("plain"), F.sum(n * (n - 1)).alias("extra")
    ).first()
    return 10.0 if not seen["plain"] else max(1.0, min(1000.0, seen["extra"] / max(seen["seen"] - seen["plain"], 1e-9) - 1))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, least: float = LEAST_RATE) -> DataFrame:
    """page_id, host, path, rule, verdict, mean and high for each row of ``pages`` (page_id, url).

    ``labels`` are (page_id, label): 1 for a good page, 0 for a bad one; nulls and pages without one are unlabelled.
    The longest rule that fits decides; else a page is blocked if its host's upper posterior bound is below
    ``least``.  Null urls and urls without :// form the host '' and are judged by its reputation.  Repeated rows are
    judged each; labels of one page_id are averaged; other columns are not read; empty tables give no row.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    one = labels.groupBy("page_id").agg(F.avg("label").alias("label"))
    seen = reputation(parsed.select("page_id", "host").join(one, "page_id", "left").select("host", "label"))
    name, says = rule_for(F.col("host"), F.col("path"), rules)
    judged = parsed.join(seen.select("host", "mean", "low", "high"), "host", "left")
    method = F.when(F.col("high") < least, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(says, method).alias("verdict"), "mean", "low", "high")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path names the document that the page shows; that document's label is taken as the page's."""
    pages = table(spark, sf_dir, "pages")
    shown = pages.select("page_id", F.regexp_extract("url", "/([0-9]{1,18})(?:[/?#.]|$)", 1).try_cast("bigint").alias("doc_id"))
    labels = shown.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").select("page_id", "label")
    found = judge(pages.select("page_id", "url"), labels)
    return found.select("page_id", "host", "path", "rule", "verdict", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def _sql_rules() -> tuple[str, str]:
    """CASE branches for the rule and for its verdict, the longest rule first."""
    ranked = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    when = "WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN '{2}'"
    return " ".join(when.format(h, p, h + p) for h, p, _ in ranked), " ".join(when.format(h, p, v) for h, p, v in ranked)


def _sql_weight(rows: str) -> str:
    return f"""SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 10.0 ELSE greatest(1.0, least(1000.0,
      sum(n * (n - 1)) / greatest(sum((good - n * up) ** 2 / greatest(up * (1 - up), 1e-6)) - sum(n), 1e-9) - 1)) END::DOUBLE AS w FROM {rows} WHERE n > 0"""


#: The same shrinkage in sums and joins.
ORACLE_SQL = rf"""
WITH part AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part),
shown AS (SELECT page_id, try_cast(regexp_extract(url, '/([0-9]{{1,18}})(?:[/?#.]|$)', 1) AS BIGINT) AS doc_id FROM pages),
labelled AS (SELECT s.page_id, avg(l.quality) AS label FROM shown s JOIN labels l ON l.doc_id = s.doc_id GROUP BY 1),
sums AS (SELECT host, count(label) AS n, coalesce(sum(label), 0)::DOUBLE AS good FROM parsed p LEFT JOIN labelled l ON l.page_id = p.page_id GROUP BY host),
bare AS (SELECT *, regexp_replace(host, '\.*(?::[0-9]*)?$', '') AS b FROM sums),
kind AS (SELECT *, regexp_matches(b, '^(?:[0-9]+(?:\.[0-9]+){{3}}|\[.*)$') AS address, regexp_matches(b, '\.(?:{'|'.join(SECOND)})\.[a-z]{{2}}$') AS wide, string_split(b, '.') AS x FROM bare),
named AS (SELECT host, n, good, CASE WHEN address THEN b WHEN wide THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS domain,
  CASE WHEN address THEN 'ip' WHEN wide THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix FROM kind),
d AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM named GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY 1),
s_up AS (SELECT *, ((SELECT sum(good) FROM s) - good + 1) / ((SELECT sum(n) FROM s) - n + 2) AS up FROM s),
w_s AS ({_sql_weight("s_up")}),
d_up AS (SELECT d.*, (s_up.good - d.good + w * up) / (s_up.n - d.n + w) AS up FROM d JOIN s_up USING (suffix), w_s),
w_d AS ({_sql_weight("d_up")}),
h_up AS (SELECT h.*, (d_up.good - h.good + w * up) / (d_up.n - h.n + w) AS up FROM named h JOIN d_up USING (domain), w_d),
w_h AS ({_sql_weight("h_up")}),
seen AS (SELECT host, n, w, (good + w * up) / (n + w) AS mean FROM h_up, w_h),
bound AS (SELECT host, mean, greatest(0.0, mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (w + n + 1))) AS low, least(1.0, mean + {DEVIATIONS} * sqrt(mean * (1 - mean) / (w + n + 1))) AS high FROM seen),
judged AS (SELECT p.*, mean, low, high FROM parsed p JOIN bound USING (host))
SELECT page_id, host, path, CASE {_sql_rules()[0]} END AS rule, CASE {_sql_rules()[1]} WHEN high < {LEAST_RATE} THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM judged
"""

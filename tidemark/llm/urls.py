"""URL verdicts: explicit rules first, else the reputation of the host; DataFrame operations only.

A page's outcome is bad if its label is toxic or of low quality. The share of bad pages of a host is shrunk towards that
of its registered domain, this towards its suffix's, and this towards the share of all, each as a beta-binomial posterior
whose prior strength is estimated from the spread of the level below it by moments (empirical Bayes). A host is
blocked if even the lower bound of its posterior (mean less `z` deviations) is over `bad_share`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: (verdict, host, path): the longest rule that fits decides.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
Z, BAD_SHARE = 1.0, 0.25
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prior strengths are kept between these, in pages.
STRENGTHS = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    """What stands between the first :// and / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of two equally long ones the first in order. A rule fits its host and all subdomains and paths that start with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label; user names and ports are left out, addresses stay whole. suffixes:
    those of two labels; all others are taken to have one."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(r"^[0-9.]+$") | bare.startswith("["), bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    """What follows a domain's first label; a domain of one label is its own suffix."""
    rest = F.regexp_extract(domain, r"(?s)^[^.]*\.(.*)$", 1)
    return F.when(rest == "", domain).otherwise(rest)


def document_of(path: Column) -> Column:
    """The number of the document that a page was made from: its path's last part, with or without .html."""
    return F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("bigint")


def reputations(pages: DataFrame, labels: DataFrame, z: float = Z, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n (labelled pages), bad, lower (lower bound of its bad share) for every host of pages (host, path).

    Page rows count each, labels (doc_id, quality, toxic) once a document, bad if any of its rows is. Without any
    label the share of all is one half, known no better than from two pages."""
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    seen = written(pages.groupBy("host", document_of(F.col("path")).alias("doc")).agg(F.count(F.lit(1)).alias("pages")), "seen")
    per_host = seen.join(label, F.col("doc") == F.col("doc_id"), "left").groupBy("host").agg(
        F.sum(F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)).alias("n"), F.sum(F.coalesce("bad", F.lit(0)) * F.col("pages")).alias("x")
    )
    hosts = per_host.select("host", domain_of(F.col("host"), suffixes).alias("domain"), "n", "x")
    hosts = written(hosts.withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "suffixes")

    def strength(level: DataFrame, parent: DataFrame | None, key: str | None, name: str) -> DataFrame:
        """One row: how many pages a parent's share is worth to its children, from their spread beyond chance."""
        own = level.where("n > 0")
        if parent is None:
            own = own.crossJoin(level.agg(F.sum("n").alias("pn"), F.sum("x").alias("px")))  # one row
        else:
            own = own.join(parent.select(key, F.col("n").alias("pn"), F.col("x").alias("px")), key)
        p = F.col("px") / F.col("pn")
        sums = own.agg(
            F.sum(F.col("n") * (F.col("x") / F.col("n") - p) * (F.col("x") / F.col("n") - p)).alias("spread"), F.sum(p * (1 - p)).alias("chance"), F.sum(F.col("n") * p * (1 - p)).alias("whole"), F.sum("n").alias("pages")
        )
        beyond, v = (F.col("spread") - F.col("chance")) / F.col("pages"), F.col("whole") / F.col("pages")
        m = F.when(beyond > 0, F.least(F.greatest(v / beyond - 1, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))).otherwise(STRENGTHS[1])
        return sums.select(F.round(m, 6).alias(name))

    strengths = strength(suffixes, None, None, "ms").crossJoin(strength(domains, suffixes, "suffix", "md")).crossJoin(strength(hosts, domains, "domain", "mh"))
    overall = suffixes.agg(((F.coalesce(F.sum("x"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("p"))
    one = written(strengths.crossJoin(overall), "strengths")  # a single row
    of = lambda x, n, m, p: (F.col(x) + F.col(m) * F.col(p)) / (F.col(n) + F.col(m))
    by_suffix = suffixes.crossJoin(F.broadcast(one)).select("suffix", of("x", "n", "ms", "p").alias("ps"), "md", "mh")
    by_domain = domains.join(by_suffix, "suffix").select("domain", of("x", "n", "md", "ps").alias("pd"), "mh")
    by_host = hosts.join(by_domain, "domain").withColumn("mean", of("x", "n", "mh", "pd"))
    strong = F.col("n") + F.col("mh")
    lower = F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (strong + 1))
    return by_host.select("host", "n", F.col("x").alias("bad"), F.round(lower, 9).alias("lower"))


def verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, bad_share: float = BAD_SHARE, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url). Null urls and such without :// have the
    empty host and path, whose reputation is judged like any other. No labels: every page without a rule is judged by
    the prior alone. Repeated rows are rows of their own, and count each; null page_ids stay null; very long urls are read
    whole. Of rules of one length the first decides; a host whose bound equals bad_share is allowed. No pages: no rows."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    table = written(reputations(rows, labels, z, suffixes).select(F.col("host").alias("h"), (F.col("lower") > bad_share).alias("bad_host")), "reputations")
    judged = rows.join(table, F.col("host") == F.col("h"), "left").withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bad_host"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"))


def op7(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """verdicts by RULES and the default bounds; other columns play no part."""
    return verdicts(pages, labels)


def _sql_rules() -> str:
    tests = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE{tests} END"


_STRENGTH = """(SELECT round(CASE WHEN sum(n * (x / n - px / pn) * (x / n - px / pn)) > sum(px / pn * (1 - px / pn)) THEN
  least(greatest(sum(n * px / pn * (1 - px / pn)) / (sum(n * (x / n - px / pn) * (x / n - px / pn)) - sum(px / pn * (1 - px / pn))) - 1, 1.0), 1000.0) ELSE 1000.0 END, 6) FROM {of} WHERE n > 0)"""
_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
#: The same rows.
OP7_SQL = rf"""
WITH rows AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
label AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
outcomes AS (
  SELECT host, bad FROM rows LEFT JOIN label ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1) AS BIGINT)),
bare AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS x, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '.') AS p
  FROM outcomes GROUP BY host),
named AS (
  SELECT host, n, x, CASE WHEN regexp_matches(array_to_string(p, '.'), '^[0-9.]+$') OR starts_with(array_to_string(p, '.'), '[') THEN array_to_string(p, '.')
    WHEN array_to_string(p[-2:], '.') IN ({_TWO}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM bare),
hosts AS (SELECT *, CASE WHEN strpos(domain, '.') = 0 OR ends_with(domain, '.') AND strpos(domain, '.') = length(domain) THEN domain ELSE substr(domain, strpos(domain, '.') + 1) END AS suffix FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY suffix),
s0 AS (SELECT *, (SELECT sum(n) FROM suffixes) AS pn, (SELECT sum(x) FROM suffixes) AS px FROM suffixes),
d0 AS (SELECT d.*, s.n AS pn, s.x AS px FROM domains d JOIN suffixes s USING (suffix)),
h0 AS (SELECT h.*, d.n AS pn, d.x AS px FROM hosts h JOIN domains d USING (domain)),
one AS (
  SELECT (SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM suffixes) AS p, {_STRENGTH.format(of="s0")} AS ms, {_STRENGTH.format(of="d0")} AS md, {_STRENGTH.format(of="h0")} AS mh),
ps AS (SELECT suffix, (x + ms * p) / (n + ms) AS ps FROM suffixes, one),
pd AS (SELECT domain, (x + md * ps) / (n + md) AS pd FROM domains JOIN ps USING (suffix), one),
ph AS (SELECT host, (x + mh * pd) / (n + mh) AS mean, n + mh AS strong FROM hosts JOIN pd USING (domain), one),
judged AS (SELECT page_id, host, path, {_sql_rules()} AS r, mean - {Z} * sqrt(mean * (1 - mean) / (strong + 1)) AS lower FROM rows JOIN ph USING (host))
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN round(lower, 9) > {BAD_SHARE} THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""

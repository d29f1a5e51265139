"""URL filters: fixed rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (good or bad) are counted for each host, registered domain and suffix. Each level's rate is
shrunk through a beta-binomial prior towards the rate of the level above (host, domain, suffix, all pages); the
prior's strength is fitted to the spread of the level's rates by moments. A page whose host is bad with a posterior
lower bound above one half is blocked.

Outcomes are given by the caller (page_id, bad), or else are weak labels that the pages' contents carry, never their
urls: a page is bad if what it shows has no letters, or more than a tenth of it without space is signs that prose does not
use. A null url has an empty host and path, no rule, and the verdict of the reputation of the empty host. A page of null
html has no outcome, nor has one that the caller does not list; hosts without outcomes take the rate of their domain.
Repeated rows are judged, and count, each. held_out() tells how well a verdict learnt from half of the pages foretells the
outcomes of the other half. Rows of hosts with a thousandth of all pages or more are spread over SALT keys in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, pick

# The rules of the contract, verdict, host and beginning of the path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second-level suffixes under which domains are registered.
SECOND_LEVEL = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Standard deviations below the posterior mean, and the bad share above which a host is blocked.
BOUND, BAD = 1.645, 0.5
#: Share of all pages from which on a host counts as hot (so there are 1,000 at most), and keys that its rows go to.
HOT, SALT = 0.001, 64


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (of equals the first by name), as verdict and rule; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last that fits wins
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _without(text: Column, start: str, end: str) -> Column:
    """The text without what stands from each start to the next end, in one pass over it; an open start reaches to the end."""
    return F.array_join(F.transform(F.split(text, end), lambda x: F.regexp_replace(x, f"(?is){start}.*", " ")), " ")


def shown(html: Column) -> Column:
    """What a page shows, about: without scripts, styles, comments and tags."""
    for start, end in (("<!--", "-->"), (r"<script\b", r"(?i)</script\s*+>"), (r"<style\b", r"(?i)</style\s*+>")):
        html = F.when(html.rlike(f"(?i){start}"), _without(html, start, end)).otherwise(html)
    return F.regexp_replace(html, r"<[^>]*+>", " ")


def outcome(html: Column) -> Column:
    """1 for a bad page, 0 for a good one, null for none: the weak labels."""
    poor = F.element_at(
        F.transform(
            F.array(shown(html)),
            lambda s: ~s.rlike(r"\p{L}") | (F.char_length(F.regexp_replace(s, r"""[\p{L}\p{M}\p{N}\s.,;:!?'"()\-]++""", "")) > 0.1 * F.char_length(F.regexp_replace(s, r"\s++", ""))),
        ),
        1,
    )
    return F.when(html.isNotNull(), poor.cast("int"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, bad and n, with the posterior mean (p) and its lower bound (low); outcomes has host and bad (0, 1 or null)."""
    hosts = outcomes.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("bad").cast("double").alias("n"))
    # a row for each host, written once: the levels above are summed from it
    hosts = keep(hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"))), "hosts")
    top = hosts.agg((F.sum("bad") + 0.5).alias("b"), (F.sum("n") + 1.0).alias("t")).select((F.col("b") / F.col("t")).alias("prior"))
    level = None
    for name, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = [k for k in ("suffix", "domain", "host")[: ("suffix", "domain", "host").index(name) + 1]]
        here = hosts.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        here = here.crossJoin(F.broadcast(top)) if above is None else here.join(level.select(*keys[:-1], F.col("p").alias("prior")), keys[:-1])  # top is one row
        # moments: what the rates spread beyond the binomial gives 1 / (1 + strength)
        p = F.col("prior") * (1 - F.col("prior"))
        fit = here.where("n > 1").agg(F.sum((F.col("bad") - F.col("n") * F.col("prior")) ** 2 - F.col("n") * p).alias("more"), F.sum(F.col("n") * (F.col("n") - 1) * p).alias("most"))
        rho = F.greatest(F.least(F.coalesce(F.col("more") / F.nullif(F.col("most"), F.lit(0.0)), F.lit(0.1)), F.lit(0.5)), F.lit(0.002))
        here = here.crossJoin(F.broadcast(fit.select((1 / rho - 1).alias("strength"))))  # one row
        level = here.withColumn("p", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))
        if name != "host":
            level = keep(level.select(*keys, "p"), name)
    spread = F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n") + F.col("strength") + 1))
    return level.select("host", "bad", "n", "p", (F.col("p") - BOUND * spread).alias("low"))


def judge(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior mean and bound for each page.

    outcomes: page_id and bad (0, 1 or null) of labelled pages, in place of the weak labels; a page that is listed
    more than once counts for each.
    """
    rows = pick(pages, "page_id", "url", "html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = keep(reputations(_outcomes(rows, outcomes)).select("host", F.col("p").alias("bad_rate"), F.col("low").alias("bad_bound")), "reputations")
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = _with_host(rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r")), seen)
    return rows.select("page_id", "host", "path", "r.rule", F.coalesce("r.verdict", F.when(F.col("bad_bound") > BAD, "block").otherwise("allow")).alias("verdict"), "bad_rate", "bad_bound")


def _outcomes(rows: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """page_id, host and bad of each page: by the caller's table, or the weak label."""
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), "html")
    if outcomes is None:
        return rows.select("page_id", "host", outcome(F.col("html")).alias("bad"))
    listed = pick(outcomes, "page_id", "bad").select(F.col("page_id").alias("labelled"), F.col("bad").cast("int").alias("bad"))
    return rows.join(listed, F.col("page_id") == F.col("labelled"), "left").select("page_id", "host", "bad")


def _with_host(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """rows joined to their host's row in seen, hot hosts by several keys."""
    pages = rows.groupBy("host").agg(F.count("*").alias("pages"))
    hot = pages.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).where(F.col("pages") >= HOT * F.col("all"))  # one row
    hot = F.broadcast(keep(hot.select("host", F.lit(True).alias("hot")), "hot-hosts"))  # 1 / HOT rows at most
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT))).otherwise(0)
    keys = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.join(hot, "host", "left").withColumn("salt", salt.cast("int")).drop("hot")
    spread = seen.join(hot, "host", "left").withColumn("salt", F.explode(keys)).drop("hot")
    return salted.join(spread, ["host", "salt"]).drop("salt")


def held_out(pages: DataFrame, outcomes: DataFrame | None = None, parts: int = 2) -> DataFrame:
    """One row: of the pages with an outcome that were not learnt from, how many are bad, judged bad, and both.

    Pages whose CRC of page_id is divisible by ``parts`` are held out; hosts that were not learnt from are judged good.
    """
    every = _outcomes(pick(pages, "page_id", "url", "html"), outcomes).withColumn("held", F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % parts == 0)
    learnt = keep(reputations(every.where("NOT held")).where(F.col("low") > BAD).select("host", F.lit(1).alias("judged")), "blocked")
    seen = every.where("held AND bad IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).join(learnt, "host", "left")
    judged = F.col("judged").isNotNull()
    return seen.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (("n", F.col("n")), ("n_bad", F.col("bad")), ("n_judged", F.when(judged, F.col("n"))), ("n_both", F.when(judged, F.col("bad"))))])

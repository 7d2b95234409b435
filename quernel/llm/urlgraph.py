"""URL filter: rules by host and path, and link-graph propagation for what they leave open.

A rule (host, path, verdict) fits the urls of its host and of all subdomains whose path starts with the rule's;
the longest rule (host and path together, then its host) that fits decides. Where none fits, the host decides:
over the edges between hosts that pages link, personalised PageRank carries trust from the hosts of allowed
pages forwards, and distrust from the hosts of blocked pages backwards, to those who link them. Both start
from a host's share of all pages that rules decide, so they compare. A host is blocked where its distrust is
above zero and at least `ratio` times its trust; a host that neither reaches is allowed. Rounds go on until ranks settle.
What reaches a host without links of its own ends there and is not dealt out again, for trust and distrust alike.

Everything is DataFrame functions. Ranks are tables by host, written after every few rounds; pages are joined
once, by host, with what is known of it.

Defined results: a null url, or one without '://', has empty host and path and is allowed, since no rule has
an empty host; null html has no links; repeated rows are judged alike; an empty table gives an empty
result; empty rules leave everything allowed; links of a host to itself don't count; a linked host's port and user
are left out, a page's host is taken as it stands in its url; texts of any length are searched for links; further columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop, lookup, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s<>\\]+)"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict from literals; verdict is allow or block."""
    row = lambda h, p, v: F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
    if not rules:
        return spark.range(0).select(F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("verdict"))
    return spark.range(1).select(F.explode(F.array(*[row(*r) for r in rules])).alias("r")).select("r.*")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without '://'."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    part = lambda p: F.coalesce(F.regexp_extract(rest, p, 1), F.lit(""))
    return F.translate(part(r"^([^/?#]*)"), _UPPER, _LOWER), part(r"^[^/?#]*([^?#]*)")


def _suffixes(host: Column) -> Column:
    """A host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: how many links pages of a host have to another host."""
    src, _ = host_path(F.col(url))
    links = pages.select(src.alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("to"))
    dst = F.regexp_replace(F.regexp_replace(F.translate("to", _UPPER, _LOWER), "^[^@]*@", ""), r":[0-9]*$", "")
    return links.select("src", dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12, cut_every: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """host, rank of personalised PageRank from seeds (host, seed) along edges (src, dst, share).

    After `rounds` rounds at least, it ends when over cut_every rounds no further host was reached and all ranks
    together changed by less than tolerance.
    """
    rank, last, k = seeds.select("host", F.col("seed").alias("rank")), None, 0
    while True:
        moved = edges.join(rank, F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        rank = moved.select(F.col("dst").alias("host"), (damping * F.col("in")).alias("rank")).unionByName(seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
        k += 1
        if k % cut_every == 0:
            rank = materialise(rank, "ranks")
            if last is not None and k >= rounds:
                both = rank.join(last.withColumnRenamed("rank", "was"), "host", "full_outer")
                # hosts of seeds or once reached keep a row, so a new one shows as a missing former rank
                new, change = both.agg(F.count_if(F.col("was").isNull()), F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()
                if not new and (change or 0.0) < tolerance:
                    return rank
            last = rank


def judge(pages: DataFrame, rules: DataFrame, ratio: float = 2.0, damping: float = 0.85, rounds: int = 12, broadcast_rules: int = 20_000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (of the host) of every row of pages."""
    host, path = host_path(F.col(url))
    parsed = materialise(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")), "parsed")
    hosts = materialise(parsed.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    rule = rules.where("host is not null and path is not null").select(F.translate("host", _UPPER, _LOWER).alias("domain"), F.col("path").alias("rule_path"), "verdict")
    rule = F.broadcast(rule) if rules.limit(broadcast_rules + 1).count() <= broadcast_rules else rule
    # the rules of a host's domains, as many as the list has for them
    fitting = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("domain")).join(rule, "domain").groupBy("host").agg(F.collect_set(F.struct((F.length("domain") + F.length("rule_path")).alias("n"), F.length("domain").alias("m"), "domain", "rule_path", "verdict")).alias("rules"))
    best = F.array_max(F.filter(F.coalesce("rules", F.array().cast(fitting.schema["rules"].dataType)), lambda r: F.startswith(F.col("path"), r["rule_path"])))
    # a hot host's pages stay where they are, see lookup
    fitting = materialise(fitting.join(hosts, "host"), "fitting")
    ruled = materialise(lookup(parsed, fitting, "host", "pages", "left").withColumn("best", best).select("page_id", "host", "path", F.concat("best.domain", "best.rule_path").alias("rule"), F.col("best.verdict").alias("rule_verdict")), "ruled")
    decided = ruled.where("rule is not null").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    total = decided.agg((F.sum("good") + F.sum("bad")).cast("double").alias("total"))  # one row
    seeds = materialise(decided.crossJoin(F.broadcast(total)).select("host", (F.col("good") / F.col("total")).alias("good"), (F.col("bad") / F.col("total")).alias("bad")), "seeds")
    edges = materialise(link_edges(pages, url, html), "edges")
    if edges.isEmpty():
        trust, distrust = (seeds.select("host", F.col(c).alias("rank")) for c in ("good", "bad"))
    else:
        share = lambda a, b: edges.join(edges.groupBy(a).agg(F.sum("weight").alias("all")), a).select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("weight") / F.col("all")).alias("share"))
        trust = propagate(materialise(share("src", "dst"), "forward"), seeds.select("host", F.col("good").alias("seed")), damping, rounds)
        distrust = propagate(materialise(share("dst", "src"), "backward"), seeds.select("host", F.col("bad").alias("seed")), damping, rounds)
    scores = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    known = materialise(hosts.join(scores, "host"), "known")
    spread = F.when((F.coalesce("distrust", F.lit(0.0)) > 0) & (F.col("distrust") >= ratio * F.col("trust")), "block").otherwise("allow")
    drop(parsed, fitting)
    return lookup(ruled, known, "host", "pages", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", spread).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

"""URL filter: explicit rules, and trust propagated over the graph of hosts.

A host is trusted to the extent of its pages under allow rules and distrusted to the
extent of its pages under block rules.  Trust flows along host edges by
personalised PageRank from the trusted hosts; distrust flows against them from the blocked
hosts (who links to a blocked host is suspect).  Mass that reaches a host without edges is
lost, which equals returning it to the seeds up to a factor.  A host is blocked when distrust
exceeds ``threshold`` of its trust and distrust together.

Edges: hyperlinks of the pages (absolute or ``//host``; links within a host are left out), and
both ways between a host and its parent domain (``blog.a.org`` - ``a.org``).  With ``whole_chain``, as in
``op6_url_filter``, the parent has an edge to its own parent too, up to the last two labels, whether it has
pages or not (``x.blog.a.org`` - ``blog.a.org`` - ``a.org``), and numeric addresses have no parent.

Scale: pages are reduced to (host, host) counts by map-side aggregation before any
shuffle, ranks are one row per host, every step is one join and one aggregate, and
lineage is cut every few steps.

Edge cases: null urls and urls without ``://`` have empty host and path, meet no rule, send no
edges and are allowed; null html has no links; repeated rows are judged each; without seeds
every page without a rule is allowed; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import TO_ASCII_LOWER, store
from lowdata.session import cut_lineage

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, STEPS, THRESHOLD, CUT_EVERY = 0.85, 20, 0.5, 5
ADDRESS = r"^[0-9.]+(:[0-9]*)?$"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), *TO_ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits; null if none does."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def parents(hosts: DataFrame, whole_chain: bool) -> DataFrame:
    """(host, up): each host with the domain one level up; with ``whole_chain`` also those domains with theirs."""
    if not whole_chain:
        parent = hosts.select("host", F.substring_index("host", ".", -2).alias("top"), F.expr("substring(host, instr(host, '.') + 1)").alias("up"))
        return parent.where("host <> top and up <> ''").select("host", "up")
    labels = hosts.where(~F.col("host").rlike(ADDRESS)).select(F.split("host", r"\.").alias("l")).where(F.size("l") > 2)
    chain = labels.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.struct(
        F.array_join(F.slice("l", i, F.size("l")), ".").alias("host"), F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("up")))).alias("c"))
    return chain.select("c.host", "c.up").distinct()


def host_edges(judged: DataFrame, whole_chain: bool = False) -> DataFrame:
    """(src, dst, w): links between different hosts, and a host with its parent domain (weight 1, both ways)."""
    links = (judged.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
             .select("src", F.translate("dst", *TO_ASCII_LOWER).alias("dst")).where("src <> dst")
             .groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))
    hosts = judged.where("host <> ''").select("host").distinct()
    parent = parents(hosts, whole_chain)
    family = (parent.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")),
                                              F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e"))
              .select("e.src", "e.dst").distinct().withColumn("w", F.lit(1.0)))
    return links.unionByName(family).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) from ``seeds(host, trust, distrust)`` over ``edges(src, dst, w)``."""
    out_w = edges.groupBy("src").agg(F.sum("w").alias("w_out"))
    in_w = edges.groupBy("dst").agg(F.sum("w").alias("w_in"))
    shares = store(edges.join(out_w, "src").join(in_w, "dst").select(
        F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") / F.col("w_out")).alias("t"), F.lit(0.0).alias("d")),
                          F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.col("w") / F.col("w_in")).alias("d")))).alias("e"))
        .select("e.*"), "host-edges")
    rank = seeds
    for step in range(1, steps + 1):
        flow = (shares.join(rank, F.col("a") == F.col("host"))
                .select(F.col("b").alias("host"), (F.col("t") * F.col("trust") * damping).alias("trust"), (F.col("d") * F.col("distrust") * damping).alias("distrust")))
        home = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
        rank = flow.unionByName(home).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if step % CUT_EVERY == 0:
            rank = cut_lineage(rank)
    return rank


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          threshold: float = THRESHOLD, whole_chain: bool = False) -> DataFrame:
    """(id, host, path, rule, verdict) per input row."""
    src = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    ruled = src.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "html", "r.rule", "r.action")
    counts = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("b"))
    counts = store(counts, "host-counts")
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    seeds = counts.where("a > 0 or b > 0").select("host", (F.col("a") / F.lit(float(total["a"] or 1))).alias("trust"),
                                                  (F.col("b") / F.lit(float(total["b"] or 1))).alias("distrust"))
    rank = propagate(store(host_edges(ruled, whole_chain), "host-links"), seeds)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    blocked = rank.where((F.col("distrust") > 0) & (share > threshold)).select(F.col("host").alias("bad"))
    return (ruled.drop("html").join(blocked, F.col("host") == F.col("bad"), "left")
            .select("id", "host", "path", "rule", F.coalesce("action", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict")))

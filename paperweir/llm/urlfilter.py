"""URL verdicts: rules first, then link-graph propagation of trust and distrust over host edges. Spark SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.llm.common import cut

#: Summed change of a round at which ranks stand still, and rounds after which that is given up with an error.
TOLERANCE, ROUNDS = 1e-9, 400

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end. Else both empty."""
    u = F.col(url) if isinstance(url, str) else url
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (ties: the earlier) that fits, and its verdict. A rule is (allow or block, host + path)."""
    for what, text in rules:
        if "/" not in text or what not in ("allow", "block"):
            raise ValueError(f"a rule is allow or block, and a host with a path from its / on, not {what!r} and {text!r}")
    order = sorted(rules, key=lambda r: -len(r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in reversed(order):
        at = text.index("/")
        domain, start = text[:at], text[at:]
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute and protocol-relative href values, counted before the shuffle."""
    href = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    link = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(href)).alias("u"))
    url = F.when(F.startswith("u", F.lit("//")), F.concat(F.lit("http:"), F.col("u"))).otherwise(F.col("u"))
    link = link.select("src", host_path(url)[0].alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return link.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _propagate(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """Personalised PageRank. edges (src, dst, w) with weights adding up to 1 per src; seeds (host, p) add up to 1.

    What a host without out-links holds returns to the seeds. Rounds go on until the summed change falls below TOLERANCE;
    a round shrinks it by the damping at least, so that 0.85 takes about 130. RuntimeError if `rounds` do not suffice."""
    base = nodes.join(seeds, "host", "left").select("host", F.coalesce("p", F.lit(0.0)).alias("p"))
    rank = base.select("host", F.col("p").alias("r"))
    out = edges.select(F.col("src").alias("host")).distinct().withColumn("linked", F.lit(True))
    for i in range(rounds):
        last = rank
        sent = edges.join(rank, edges.src == rank.host).groupBy("dst").agg(F.sum(F.col("r") * F.col("w")).alias("got"))
        kept = rank.join(out, "host").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("flow"))
        rank = base.join(sent, base.host == sent.dst, "left").crossJoin(F.broadcast(kept)).select(  # one row
            base.host, (F.col("p") * (1 - damping * F.col("flow")) + damping * F.coalesce("got", F.lit(0.0))).alias("r")
        )
        if i % 4 == 3 or i == rounds - 1:
            now = cut(rank.join(last.select("host", F.col("r").alias("was")), "host"))
            rank = now.select("host", "r")
            change = now.agg(F.coalesce(F.sum(F.abs(F.col("r") - F.col("was"))), F.lit(0.0))).first()[0]
            if change < TOLERANCE:
                return rank
    raise RuntimeError(f"ranks still change by {change:.3g} after {rounds} rounds")


def host_trust(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust): PageRank from trusted seeds along links, and from blocked seeds against them.

    seeds (host, good, bad): pages of a host that a rule allows and blocks; each kind's shares add up to 1. Hosts are those
    of seeds and edges. Without edges, only seeds hold anything."""
    edges = cut(edges)
    nodes = cut(seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct().join(seeds, "host", "left"))
    out = []
    linked = edges.limit(1).count() > 0
    for column, a, b in (("good", "src", "dst"), ("bad", "dst", "src")):
        turned = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), "n")
        total = turned.groupBy("src").agg(F.sum("n").alias("m"))
        weighted = turned.join(total, "src").select("src", "dst", (F.col("n") / F.col("m")).alias("w"))
        all_seeds = nodes.agg(F.coalesce(F.sum(column), F.lit(0)).alias("all"))
        start = nodes.crossJoin(F.broadcast(all_seeds)).where(f"{column} > 0").select("host", (F.col(column) / F.col("all")).alias("p"))  # one row
        out.append(_propagate(cut(weighted), nodes.select("host"), start, damping, rounds) if linked else nodes.select("host").join(start, "host", "left").select("host", F.coalesce("p", F.lit(0.0)).alias("r")))
    trust, distrust = out[0].withColumnRenamed("r", "trust"), out[1].withColumnRenamed("r", "distrust")
    return trust.join(distrust, "host")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", damping: float = 0.85, rounds: int = ROUNDS) -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust.

    A rule decides where one fits. Elsewhere a host is blocked if its distrust exceeds its trust (both rounded to 12 places,
    so that the order of sums does not decide); a host that neither reaches, or an empty one, is allowed. Null urls have an
    empty host and path, null html no links. Repeated rows are judged alike, and their links count once each; html of any
    length is searched whole; of rules of one length the earlier wins; an empty table gives no rows. Columns of pages with
    these names are replaced.
    """
    host, path = host_path(url)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    parsed = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("by_rule", verdict)
    seeds = parsed.where("rule is not null").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    scores = host_trust(host_edges(parsed, "host", html), cut(seeds), damping, rounds)
    judged = cut(scores.select("host", F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust")))
    result = parsed.join(judged, "host", "left")
    method = F.when(F.col("distrust") > F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return result.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "trust", "distrust")

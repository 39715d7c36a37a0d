"""Risk algebra: weighed components, layers fused into a level, the action a level asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import content, level, with_neural
from palisade.operators.behavior import TRACE, behavior_of, traces
from palisade.operators.edge import banned, edge
from palisade.operators.windows import by_size, heavy_keys, rows_at_most, running
from palisade.session import spread, written
from palisade.sources.tables import once

#: Share of each layer in the total.
LAYERS = {"edge": 0.2, "neural": 0.5, "behavior": 0.3}
WEIGHTS = {"ip_reputation": 0.15, "rate_limit_pressure": 0.10, "prompt_injection": 0.25, "content_toxicity": 0.15, "behavioral_anomaly": 0.20, "style_drift": 0.10, "coordinated_attack": 0.05}


def total(edge_score: Column, neural_score: Column, behavior_score: Column) -> Column:
    return F.least(F.lit(1.0), edge_score * LAYERS["edge"] + neural_score * LAYERS["neural"] + behavior_score * LAYERS["behavior"])


def unified(components: DataFrame, key: str) -> DataFrame:
    """components: key, source, score, weight, confidence. Weighed score and confidence of each key within 0 to 1 (0 without weight), and whether one component is critical by itself."""
    weight = F.sum("weight")
    over = lambda v: F.when(weight != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(v) / weight))).otherwise(0.0)
    critical = ((F.col("source") == "prompt_injection") & (F.col("score") > 0.9)) | ((F.col("source") == "coordinated_attack") & (F.col("score") > 0.8))
    return components.groupBy(key).agg(over(F.col("score") * F.col("weight") * F.col("confidence")).alias("score"), over(F.col("confidence") * F.col("weight")).alias("confidence"), F.coalesce(F.bool_or(critical), F.lit(False)).alias("has_critical"))


def unified_level(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score >= 0.1, "low").otherwise("none")


def multiplier(name: Column) -> Column:
    """Factor on the rate limit of a level."""
    return F.when(name == "none", 1.0).when(name == "low", 0.9).when(name == "medium", 0.5).when(name == "high", 0.25).when(name == "critical", 0.0)


def recommended(score: Column, injection: Column, coordinated: Column) -> Column:
    """injection, coordinated: the highest score of such a component, or null."""
    return F.when((injection > 0.9) | (coordinated > 0.8) | (score >= 0.9), "block").when(score >= 0.7, "challenge").when(score >= 0.5, "rate_limit").when(score >= 0.3, "monitor").otherwise("allow")


def action(name: Column, flags: Column) -> Column:
    """Action for a level: a medium one with two flags or more is challenged, else limited."""
    return F.when(name == "critical", "block").when(name == "high", "challenge").when(name == "medium", F.when(F.size(flags) >= 2, "challenge").otherwise("rate_limit")).when(name == "low", "rate_limit").otherwise("allow")


#: How long a critical request bans its address and its agent.
BAN_US = 86_400_000_000


def fed_back(decided: DataFrame, heavy: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ip_banned and agent_banned: whether a critical request of the address, or of the agent, came in the BAN_US before a row.

    decided: request_id, ts_us, client_ip, agent (one that begins with a zero character names no agent), level. A critical
    request renews the ban. A row's own level doesn't ban it.
    """
    critical = F.when(F.col("level") == "critical", F.col("ts_us"))

    def last(key: str, name: str) -> Callable[[DataFrame, bool], DataFrame]:
        return lambda x, cut: running(x, [key], "ts_us", "request_id", {name: critical}, cut=cut, of=F.max)

    r = by_size(decided, "client_ip", heavy or {}, last("client_ip", "_ip"))
    r = by_size(r, "agent", heavy or {}, last("agent", "_agent"))
    recent = lambda c: F.coalesce(F.col("ts_us") - F.col(c) <= BAN_US, F.lit(False))
    return r.withColumns({"ip_banned": recent("_ip") & F.col("client_ip").isNotNull(), "agent_banned": recent("_agent") & ~F.col("agent").startswith("\0")}).drop("_ip", "_agent")


def decisions(requests: DataFrame, threats: DataFrame, cidr: DataFrame, bans: DataFrame) -> DataFrame:
    """request_id, layer, level, action, ban, score, flags of every request through all layers. Requests delivered again count once.

    A request from an address with a ban in force, or whose address or agent sent a critical request in the day before, is
    blocked, whatever its level; its layer, level, score and flags stay. ban: listed, ip, agent, or null.

    layer: where the decision fell. A request critical at the edge, or high after the text layer, is decided there and is no
    part of the history of the behaviour layer, whose windows run over the remaining requests only.

    The text is read in the scan; what goes on from there is narrow rows without it.
    """
    rows = spread(requests).withColumn("_content", content(F.col("path"), F.col("query_string"), F.col("body")))
    rows = traces(with_neural(rows, "_content", "_nf", "_n"), "_nf", "_n")
    rows = written(once(rows, "request_id"), "traces")
    both = rows.join(edge(rows.select("request_id", "client_ip", "ts_us", "path"), threats, cidr), "request_id")
    two = total(F.col("edge_score"), F.col("_n"), F.lit(0.0))
    early = F.when(F.col("edge_score") >= 0.8, "edge").when(level(two).isin("high", "critical"), "neural")
    both = written(both.withColumn("_early", early), "layers")
    slow = behavior_of(both.where("_early IS NULL").select(*TRACE))
    r = both.select("request_id", "ts_us", "client_ip", "agent", "edge_flags", "edge_score", "_nf", "_n", "_early").join(slow, "request_id", "left")
    at_edge = F.col("_early") == "edge"
    layer = F.coalesce("_early", F.lit("behavior"))
    score3 = F.when(at_edge, F.col("edge_score")).otherwise(total(F.col("edge_score"), F.col("_n"), F.coalesce("behavior_score", F.lit(0.0))))
    all_flags = F.when(at_edge, F.col("edge_flags")).otherwise(F.concat("edge_flags", "_nf", F.coalesce("behavior_flags", F.array().cast("array<string>"))))
    out = r.select("request_id", "ts_us", "client_ip", "agent", layer.alias("layer"), score3.alias("score"), all_flags.alias("flags"))
    named = out.withColumn("level", level(F.round("score", 9)))
    heavy = heavy_keys(both, ["client_ip", "agent"], rows_at_most(both))
    listed = by_size(named, "client_ip", heavy, lambda x, cut: banned(x, bans, cut=cut))
    fed = fed_back(listed, heavy)
    ban = F.when(F.col("is_banned"), "listed").when(F.col("ip_banned"), "ip").when(F.col("agent_banned"), "agent")
    act = F.when(ban.isNotNull(), "block").otherwise(action(F.col("level"), F.col("flags")))
    return fed.select("request_id", "layer", "level", act.alias("action"), ban.alias("ban"), "score", "flags")


def pipeline(requests: DataFrame, threats: DataFrame, cidr: DataFrame, bans: DataFrame) -> DataFrame:
    """request_id, layer, level, action, score, flags of ``decisions``."""
    return decisions(requests, threats, cidr, bans).drop("ban")

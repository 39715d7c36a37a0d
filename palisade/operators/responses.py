"""What a decision looks like to the caller: details, status, headers and body of each action, and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Requests a minute of a limited caller, by level.
RPM = {"medium": 30, "low": 60}
BAN_SECS = 86_400

# Error, HTTP status, code.
ERRORS = [
    ("RateLimitExceeded", 429, "RATE_LIMITED"), ("IpBlocked", 403, "IP_BLOCKED"), ("AgentBlocked", 403, "AGENT_BLOCKED"), ("PromptInjectionDetected", 400, "PROMPT_INJECTION"),
    ("ContentPolicyViolation", 400, "CONTENT_VIOLATION"), ("BehavioralAnomaly", 403, "BEHAVIORAL_ANOMALY"), ("ChallengeRequired", 428, "CHALLENGE_REQUIRED"), ("ModelInference", 500, "MODEL_ERROR"),
    ("Configuration", 500, "CONFIG_ERROR"), ("Database", 500, "DB_ERROR"), ("Cache", 500, "CACHE_ERROR"), ("Internal", 500, "INTERNAL_ERROR"),
    ("ChallengeNotFound", 404, "CHALLENGE_NOT_FOUND"), ("ChallengeExpired", 410, "CHALLENGE_EXPIRED"), ("ChallengeFailed", 400, "CHALLENGE_FAILED"), ("InvalidInput", 400, "INVALID_INPUT"),
]


def errors(spark: SparkSession) -> DataFrame:
    """error, status, code and whether the server is to blame."""
    return spark.createDataFrame(ERRORS, "error string, status int, code string").withColumn("is_server_error", F.col("status") >= 500)


def json_of(**columns: Column) -> Column:
    """A JSON object of the fields that are not null, in the order given."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def _rpm(level: Column) -> Column:
    return F.when(level == "medium", RPM["medium"]).otherwise(RPM["low"])


def details(action: Column, level: Column, challenge_id: Column, kind: Column) -> Column:
    """Details of an action, as JSON."""
    return F.when(action == "block", json_of(reason=F.lit("Security threat detected"), retry_after_secs=F.lit(BAN_SECS))).when(action == "challenge", json_of(challenge_id=challenge_id, challenge_type=kind)).when(action == "rate_limit", json_of(requests_per_minute=_rpm(level))).otherwise("{}")


def middleware(action: Column, level: Column, challenge_id: Column, kind: Column, epoch: Column) -> dict[str, Column]:
    """status_code, proceeds, headers and body of the answer before a request reaches its handler."""
    status = F.when(action == "block", 403).when(action == "challenge", 429).otherwise(200)
    headers = F.when(action == "block", json_of(**{"Retry-After": F.lit(str(BAN_SECS))})).when(action == "challenge", json_of(**{"X-Challenge-ID": challenge_id})).when(action == "rate_limit", json_of(**{"X-RateLimit-Remaining": _rpm(level).cast("string"), "X-RateLimit-Reset": (epoch + 60).cast("string")})).otherwise("{}")
    body = F.when(action == "block", json_of(error=F.lit("Forbidden"), message=F.lit("Security threat detected"), retry_after=F.lit(BAN_SECS))).when(action == "challenge", json_of(error=F.lit("Challenge Required"), challenge=F.struct(challenge_id.alias("id"), kind.alias("type"), F.lit(300).alias("expires_in"))))
    return {"status_code": status, "proceeds": action.isin("allow", "rate_limit"), "headers": headers, "body": body}


def thousandths(score: Column) -> Column:
    """A score of 0 to 1 with three decimals, rounded from its exact binary value, as other languages print it."""
    unit = float(1 << 52)
    high = F.floor(score * unit)
    low = ((score * unit - high) * unit).cast("bigint")
    big = lambda x: x.cast("decimal(38,0)")
    exact = big(big(high) * F.lit(1 << 52)) + big(low)
    whole = big(F.lit(str(1 << 104)))
    scaled = big(big(exact * 1000) + big(F.lit(str(1 << 103))))
    t = ((scaled - scaled % whole) / whole).cast("bigint")
    return F.format_string("%d.%03d", F.floor(t / 1000), t % 1000)


def enforcement(action: Column, key: Column, score: Column, factor: Column) -> dict[str, Column]:
    """status, allowed, headers and body of an enforced decision; factor: share of the rate limit that is left."""
    status = F.when(action == "block", 403).when(action == "challenge", 428).otherwise(200)
    base = {"X-Request-ID": key.cast("string"), "X-Risk-Score": thousandths(score)}
    headers = F.when(action == "rate_limit", json_of(**base, **{"X-RateLimit-Limit": F.round(factor * 100).cast("int").cast("string")})).when(action == "challenge", json_of(**base, **{"Retry-After": F.lit("60")})).when(action == "block", json_of(**base, **{"Retry-After": F.lit(str(BAN_SECS))})).otherwise(json_of(**base))
    error = lambda code, text: F.to_json(F.struct(F.struct(F.lit(code).alias("code"), F.lit(text).alias("message")).alias("error")))
    body = F.when(action == "challenge", error("CHALLENGE_REQUIRED", "Security challenge required")).when(action == "block", error("BLOCKED", "Security threat detected")).otherwise("{}")
    return {"status": status, "allowed": action.isin("allow", "rate_limit"), "headers": headers, "body": body}


def envelope(data: Column, error: Column) -> Column:
    """success, and either data or error, as JSON."""
    return F.when(error.isNull(), F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data")))).otherwise(F.to_json(F.struct(F.lit(False).alias("success"), error.alias("error"))))

"""Challenges: generated for a row, answered in attempts, open until they expire, are solved or run out of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KINDS = ("ProofOfWork", "Interactive", "Token", "RateDelay", "SignatureVerification")
EXPIRY_SECS, ATTEMPTS = 300, 3


def difficulty(level: Column) -> Column:
    """Zeros a proof of work has to begin with."""
    return F.when(level == "critical", 6).when(level == "high", 5).otherwise(4)


def digest(key: Column, part: str) -> Column:
    """What stands for random numbers: a function of the row's key, so that a task run again gives the same challenge."""
    return F.sha2(F.concat(F.lit(f"{part}-"), key.cast("string")), 256)


def _number(key: Column, part: str, below: int) -> Column:
    return F.conv(F.substring(digest(key, part), 1, 8), 16, 10).cast("bigint") % below


def generated(rows: DataFrame, key: str, kind: str, level: str) -> DataFrame:
    """Adds challenge_id, data (JSON) and solution (empty where the answer is computed). A kind that is none of KINDS gets no data."""
    k, what = F.col(key), F.col(kind)
    nonce, token = F.substring(digest(k, "nonce"), 1, 32), F.substring(digest(k, "token"), 1, 32)
    zeros = difficulty(F.col(level))
    a, b = _number(k, "a", 10) + 1, _number(k, "b", 10) + 1
    field = lambda **columns: F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))
    data = (
        F.when(what == "ProofOfWork", field(algorithm=F.lit("sha256"), difficulty=zeros, nonce=nonce, prefix=F.repeat(F.lit("0"), zeros)))
        .when(what == "Interactive", field(question=F.concat(F.lit("What is "), a, F.lit(" + "), b, F.lit("?")), type=F.lit("math")))
        .when(what == "Token", field(token=token))
        .when(what == "RateDelay", field(delay_ms=_number(k, "delay", 2000) + 1000, token=token))
        .when(what == "SignatureVerification", field(algorithm=F.lit("ed25519"), nonce=nonce))
    )
    solution = F.when(what == "Interactive", (a + b).cast("string")).when(what.isin("Token", "RateDelay"), token).otherwise("")
    return rows.withColumns({"challenge_id": F.substring(digest(k, "id"), 1, 32), "data": data, "solution": solution})


def solves(kind: Column, data: Column, solution: Column, response: Column) -> Column:
    """Whether a response is right. A proof of work without a difficulty has 4, one without a nonce an empty one; a signature can't be verified here."""
    path = lambda name, default: F.coalesce(F.get_json_object(data, f"$.{name}"), F.lit(default))
    zeros = F.repeat(F.lit("0"), path("difficulty", "4").cast("int"))
    right = F.when(kind == "ProofOfWork", F.sha2(F.concat(path("nonce", ""), response), 256).startswith(zeros)).when(kind == "SignatureVerification", F.lit(False)).otherwise(response == solution)
    return F.coalesce(right, F.lit(False))


def verified(attempts: DataFrame, challenges: DataFrame, expiry_secs: int = EXPIRY_SECS, most: int = ATTEMPTS) -> DataFrame:
    """attempts: attempt_id, challenge_id, response, epoch; challenges: challenge_id, kind, data, solution, created_epoch. Adds outcome to attempts.

    solved or wrong; not_found (no such challenge, or none any more: it was solved, or it was found expired or used up
    before), expired, exhausted (more than ``most`` attempts). Attempts count in the order of (epoch, attempt_id).
    """
    c = challenges.select("challenge_id", "kind", "data", "solution", "created_epoch")
    x = attempts.select("attempt_id", "challenge_id", "response", "epoch").join(c, "challenge_id", "left")
    x = x.withColumn("_late", F.col("epoch") > F.col("created_epoch") + expiry_secs).withColumn("_right", solves(F.col("kind"), F.col("data"), F.col("solution"), F.col("response")))
    before = W.partitionBy("challenge_id").orderBy("epoch", "attempt_id").rowsBetween(W.unboundedPreceding, -1)
    n = F.coalesce(F.count(F.lit(1)).over(before), F.lit(0))
    solved = F.coalesce(F.max((F.col("_right") & (F.col("_n") < most) & ~F.col("_late")).cast("int")).over(before), F.lit(0)) == 1
    gone = F.coalesce(F.max(F.col("_late").cast("int")).over(before), F.lit(0)) == 1
    x = x.withColumn("_n", n).withColumns({"_solved": solved, "_gone": gone})
    outcome = F.when(F.col("kind").isNull() | F.col("_solved") | F.col("_gone") | (F.col("_n") > most), "not_found").when(F.col("_late"), "expired").when(F.col("_n") == most, "exhausted").when(F.col("_right"), "solved").otherwise("wrong")
    return x.select("attempt_id", "challenge_id", "epoch", outcome.alias("outcome"))


def pending(challenges: DataFrame, outcomes: DataFrame, now_epoch: Column, expiry_secs: int = EXPIRY_SECS) -> DataFrame:
    """Challenges that are neither solved nor used up nor expired at now_epoch."""
    done = outcomes.where(F.col("outcome").isin("solved", "expired", "exhausted")).select("challenge_id").distinct()
    return challenges.join(done, "challenge_id", "left_anti").where(F.col("created_epoch") + expiry_secs > now_epoch)

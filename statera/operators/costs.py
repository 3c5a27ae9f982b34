"""List prices of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.constants import PRICES
from statera.functions import scalar as S
from statera.scratch import finished


def priced(calls: DataFrame) -> DataFrame:
    """calls with the list price of the longest pattern in their model's name, and listed, what they cost by it; 0 where none fits. The
    price table is fixed and tiny."""
    model, out = F.lower("model"), None
    for name, (a, b) in sorted(PRICES.items(), key=lambda kv: -len(kv[0])):
        price = F.struct(F.lit(a).cast("bigint").alias("pp"), F.lit(b).cast("bigint").alias("cp"))
        out = F.when(model.contains(name), price) if out is None else out.when(model.contains(name), price)
    return calls.withColumn("price", out).withColumn("listed", S.list_price("prompt_tokens", "completion_tokens", "price.pp", "price.cp"))


def effective(calls: DataFrame) -> DataFrame:
    """calls with effective: the stored list price, or today's where that is zero."""
    return priced(calls).withColumn("effective", F.when(F.col("list_price_microusd") != 0, F.col("list_price_microusd")).otherwise(F.col("listed")))


_LEDGER = "call_id string, run_id string, provider string, model string, prompt_tokens bigint, completion_tokens bigint, list_price_microusd bigint, cached boolean, failed boolean, attempt string"


def append(ledger: str, calls: DataFrame, attempt: str) -> bool:
    """Adds the rows of one attempt to the append-only ledger, once: an attempt that is there already adds nothing (False), and one that was
    broken off before its commit is written again. A call served from the cache has used nothing, a failed one is recorded with its status.
    calls: call_id, run_id, provider, model, prompt_tokens, completion_tokens, cached, http_status. Read the ledger by recorded_calls()."""
    at = f"{ledger}/attempt={attempt}"
    if finished(calls.sparkSession, at):
        return False
    paid = lambda c: F.when(F.col("cached"), F.lit(0).cast("bigint")).otherwise(F.col(c).cast("bigint"))
    out = priced(calls.withColumns({c: paid(c) for c in ("prompt_tokens", "completion_tokens")}))
    failed = F.col("http_status") != 200
    out.select("call_id", "run_id", "provider", "model", "prompt_tokens", "completion_tokens", F.col("listed").alias("list_price_microusd"), "cached", failed.alias("failed")).write.mode("overwrite").parquet(at)
    return True


def recorded_calls(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows with the attempt that wrote each."""
    return spark.read.schema(_LEDGER).option("basePath", ledger).parquet(ledger)


def with_cache(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """calls (request_key) with cached and response: those whose key the cache holds need no model."""
    known = cache.select("request_key", "response", F.lit(True).alias("_hit"))
    return calls.join(known, "request_key", "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def recorded(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with the answers it lacks; what is recorded once stays as it is."""
    new = answers.select("request_key", "response").dropDuplicates(["request_key"])
    return cache.unionByName(new.join(cache, "request_key", "left_anti"))

"""Rule-based explanations: does a lot suit small businesses by its value?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest value that suits a small business.
VALUE_THRESHOLD_EUR = 250_000.0
VALUE_THRESHOLD_USD = 25_000.0
PROCEDURE_TYPES = ("open", "restricted", "simplified")
RULE_VERSION = "1.0.0"


def passes_threshold(amount: Column, threshold: Column) -> Column:
    """True, false, or null if either is missing."""
    return amount.cast("double") <= threshold.cast("double")


def headline(friendly: Column) -> Column:
    return F.when(friendly, "Highlighted: this lot suits small businesses.").when(~friendly, "This lot misses the criteria for small businesses.").otherwise("Inconclusive: whether this lot suits small businesses.")


def number_text(x: Column) -> Column:
    """A double in plain notation with at least one decimal."""
    t = F.regexp_replace(x.cast("decimal(38,6)").cast("string"), "0+$", "")
    return F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t)


def narrative(friendly: Column, amount: Column, threshold: Column, procedure: Column, codes: Column) -> Column:
    first = (
        F.when(friendly, "Judged by its estimated value and its procedure, this lot suits small businesses.")
        .when(~friendly, "Judged by its estimated value and its procedure, this lot does not suit small businesses.")
        .otherwise("The assessment for small businesses stays inconclusive, as data is missing.")
    )
    return F.concat_ws(
        " ", first,
        F.concat(F.lit("The estimated value is "), number_text(amount), F.lit(" EUR, the threshold "), number_text(threshold), F.lit(" EUR.")),
        F.when(procedure != "", F.concat(F.lit("The procedure is '"), procedure, F.lit("'."))),
        F.when(F.size(codes) > 0, F.concat(F.lit("Classification codes: "), F.array_join(codes, ", "), F.lit("."))),
    )


def explanations(lots: DataFrame, threshold: float = VALUE_THRESHOLD_EUR, agent: str = "urn:agent:rollcall", source: str = "urn:source:lots") -> DataFrame:
    """A bundle a lot, from (lot_id, amount, currency, procedure_type, codes,
    win_rate): evidence, attribution, headline and narrative."""
    t = F.lit(threshold)
    ok = passes_threshold(F.col("amount"), t)
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    evidence = F.struct(
        F.lit("SMALL_BUSINESS_EVIDENCE_V1").alias("type"), F.col("lot_id").alias("lotId"), F.col("amount").alias("estimatedValueAmount"), F.coalesce("currency", F.lit("EUR")).alias("estimatedValueCurrency"), t.alias("valueThresholdEur"),
        F.col("procedure_type").alias("procedureType"), F.size(codes).alias("numCodes"), F.col("win_rate").alias("historicalWinRate"), F.lit(source).alias("sourceSystemUri"), ok.alias("isFriendlyByValue"),
    )
    attribution = F.struct(F.lit("small-business-rule-v1").alias("modelId"), F.lit("rule-based").alias("modelType"), F.lit(RULE_VERSION).alias("ruleVersion"), F.lit(agent).alias("developerAgentId"))
    return lots.select(
        F.concat(F.lit("explanation:small-business:"), "lot_id").alias("bundle_id"), F.col("lot_id").alias("subject_id"), F.lit("small-business-value").alias("explanation_type"),
        headline(ok).alias("headline"), narrative(ok, F.col("amount"), t, F.col("procedure_type"), codes).alias("narrative"), evidence.alias("evidence"), attribution.alias("attribution"),
    )

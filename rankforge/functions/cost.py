"""Prices of models and the cost of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: USD a million tokens, in and out (fixed values); unknown models cost nothing. A parameter: pass your own table.
PRICES: dict[str, tuple[float, float]] = {
    "text-embedding-3-small": (0.02, 0.0), "text-embedding-3-large": (0.13, 0.0), "gpt-5.4-nano": (0.20, 1.25), "gpt-5.4-mini": (0.75, 4.50), "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00),
}
#: Token and cost columns of a question or of an ingestion.
COST_COLUMNS = {
    "embedding_input_tokens": "long", "embedding_cost": "double", "llm_prompt_tokens": "long", "llm_completion_tokens": "long", "llm_cost": "double", "judge_prompt_tokens": "long",
    "judge_completion_tokens": "long", "judge_cost": "double", "rerank_cost": "double", "query_rewrite_cost": "double",
}


def cost_columns(**known: Column) -> list[Column]:
    """Every cost column, zero where not given, and ``total_cost``."""
    each = {c: F.coalesce(known.get(c, F.lit(0)), F.lit(0)).cast(t) for c, t in COST_COLUMNS.items()}
    total = sum((each[c] for c in each if c.endswith("_cost")), F.lit(0.0))
    return [v.alias(c) for c, v in each.items()] + [total.alias("total_cost")]


def model_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    cost = F.lit(0.0)
    for name, (a, b) in (prices or PRICES).items():
        cost = F.when(model == name, tokens_in * a / 1e6 + tokens_out * b / 1e6).otherwise(cost)
    return cost


def total_cost(rows: DataFrame, *groups: str) -> DataFrame:
    """Sums of every numeric cost column."""
    numbers = [c for c, t in rows.dtypes if t in ("double", "bigint", "int") and c not in groups]
    return rows.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in numbers])

"""Registration of queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(queries: dict, oracles: dict, sql: str | None = None):
    """Decorator: the function is a query under its own name, sql what it equals."""

    def add(f):
        queries[f.__name__] = f
        if sql is not None:
            oracles[f.__name__] = sql
        return f

    return add


def sample(key: str, texts: list[str]) -> str:
    """SQL for one of the texts by key, for Spark and for DuckDB; {n} in a text is the key's remainder by 97."""
    cases = []
    for i, text in enumerate(texts):
        parts = [f"'{p}'" for p in text.split("{n}")]
        cases.append(f"when {i} then concat({f', cast(({key}) % 97 as string), '.join(parts)})")
    return f"case ({key}) % {len(texts)} {' '.join(cases)} end"


def ladder(text: str, rules: list[tuple[str, str]], default: str | None = "unknown") -> str:
    """DuckDB SQL for the value of the first pattern that fits."""
    cases = " ".join(f"when regexp_matches({text}, '{p}') then '{v}'" for p, v in rules)
    return f"case {cases} {f"else '{default}'" if default else ''} end"


#: DuckDB: the distinct items of a list in order.
ORDERED = "list_filter({x}, lambda item, place: list_position({x}, item) = place)"

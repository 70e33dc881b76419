"""A catalog of named relational stages, each one SQL text that Spark and DuckDB both read.

A stage names the stages it reads in braces.  Spark builds it from their DataFrames (`build`), cutting the lineage
after stages marked so, which keeps Catalyst from inlining the arithmetic of one stage into the next; `sql` gives the
whole chain as one DuckDB statement.  A few notations are translated: RINT<x> rounds half to even, SERIES<a;b> is a
table of integers, PCT(x, q) the interpolated quantile, and E<k> element k of an embedding.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import ranking
from .store import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Stage:
    text: str
    cut: bool = False
    #: Makes the stage in Spark from its sources, where the SQL text would put all rows into one task or move too many.
    make: Callable[..., DataFrame] | None = None
    #: Sources of `make`, if they are not those that the text reads.
    needs: tuple[str, ...] = ()
    #: Column of its sources by which Spark deals their rows first, since a table may lie in one file that one task reads.
    dealt: str | None = None


STAGES: dict[str, Stage] = {}
#: query name -> stage of the same name
QUERIES: list[str] = []


def stage(name: str, text: str, cut: bool = False, make: Callable[..., DataFrame] | None = None, needs: tuple[str, ...] = (), dealt: str | None = None) -> None:
    STAGES[name] = Stage(text, cut, make, needs, dealt)


def query(name: str, text: str) -> None:
    """A stage that is registered as a query of its own."""
    stage(name, text)
    QUERIES.append(name)


def numbered(name: str, source: str, by: str, into: str = "rk", value: str | None = None) -> None:
    """A stage that adds places in the order `by`, and with `value` its running sums lo and hi."""
    sums = f", sum({value}) OVER (ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi" if value else ""
    text = f"SELECT s.*, row_number() OVER (ORDER BY {by}) AS {into}{sums} FROM {{{source}}} s"
    if value:
        text = f"SELECT r.*, hi - {value} AS lo FROM ({text}) r"
    STAGES[name] = Stage(text, True, lambda df: ranking.numbered(df, by.split(", "), into, value))


def _translate(text: str, spark: bool) -> str:
    rules = (
        (r"E<(\d+)>", lambda m: f"CAST(embedding[{int(m[1]) + (not spark)}] AS DOUBLE)"),
        (r"RINT<([^<>]*)>", r"rint(\1)" if spark else r"round_even(\1, 0)"),
        (r"SERIES<([^;<>]*);([^<>]*)>", r"LATERAL explode(sequence(CAST(\1 AS INT), CAST(\2 AS INT)))" if spark else r"unnest(generate_series(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))"),
        (r"\bPCT\(", "percentile(" if spark else "quantile_cont("),
    )
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    return text


def reads(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", STAGES[name].text)))


def build(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    made = {} if made is None else made
    if name not in made:
        if name in TABLES and name not in STAGES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sources = {x: build(spark, sf_dir, x, made) for x in STAGES[name].needs or reads(name)}
            if STAGES[name].dealt:
                sources = {x: df.repartition(STAGES[name].dealt) for x, df in sources.items()}
            make = STAGES[name].make
            df = make(*sources.values()) if make else spark.sql(_translate(STAGES[name].text, True), **sources)
            made[name] = cut(df) if STAGES[name].cut else df
    return made[name]


def sql(name: str) -> str:
    order: list[str] = []

    def visit(x: str) -> None:
        if x in STAGES and x not in order:
            for y in reads(x):
                visit(y)
            order.append(x)

    visit(name)
    body = lambda x: re.sub(r"\{(\w+)\}", r"\1", _translate(STAGES[x].text, False))
    head = ", ".join(f"{x} AS ({body(x)})" for x in order[:-1])
    return (f"WITH {head} " if head else "") + body(name)

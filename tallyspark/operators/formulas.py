"""Metrics calculated by stored formulas: arithmetic over metric names, evaluated in the order of their dependencies.

Fixed values: the formulas of the configuration. Evaluating the four ratios is an extension; free cash flow subtracts the magnitude of
capital expenditures, as the calculated metric does.
"""

from __future__ import annotations

import ast
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMULAS = {
    "debt_to_equity": "total_debt / shareholders_equity",
    "current_ratio": "current_assets / current_liabilities",
    "quick_ratio": "(current_assets - inventory) / current_liabilities",
    "interest_coverage": "net_income / interest_expense",
    "free_cash_flow": "operating_cash_flow - abs(capital_expenditures)",
    "total_debt": "current_debt + long_term_debt",
}


def names_in(formula: str) -> set[str]:
    """The metrics that a formula reads."""
    tree = ast.parse(formula, mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def compiled(formula: str, value: dict[str, Column]) -> Column:
    """The formula as a column: numbers, names, + - * /, signs and abs(). Dividing by zero and missing inputs give null."""

    def of(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
            case ast.Name(id=name) if name in value:
                return value[name]
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -of(inner)
            case ast.Call(func=ast.Name(id="abs"), args=[inner], keywords=[]):
                return F.abs(of(inner))
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return of(a) + of(b)
            case ast.BinOp(left=a, op=ast.Sub(), right=b):
                return of(a) - of(b)
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                return of(a) * of(b)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.try_divide(of(a), of(b))
        raise ValueError(f"a formula may hold no {ast.unparse(node)!r}: {formula}")

    return of(ast.parse(formula, mode="eval").body)


def evaluation_order(formulas: dict[str, str]) -> list[str]:
    """The formulas' metrics, each after those it reads; a cycle raises graphlib.CycleError."""
    graph = {metric: sorted(names_in(f)) for metric, f in formulas.items()}
    return [m for m in TopologicalSorter(graph).static_order() if m in formulas]


def evaluated(metrics: DataFrame, keys: list[str], formulas: dict[str, str] = FORMULAS) -> DataFrame:  # noqa: B006
    """keys, metric, value of every formula with a value. metrics: keys, metric, value; of several values of a metric the largest counts.

    One aggregation holds a key's inputs as columns; formulas that read others follow them as projections. A metric with a formula takes
    its value from it, and from the given one where the formula has none.
    """
    order = evaluation_order(formulas)
    inputs = sorted({n for f in formulas.values() for n in names_in(f)} | set(formulas))
    wide = metrics.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == n, F.col("value").cast("double"))).alias(f"m_{n}") for n in inputs))
    for metric in order:
        made = compiled(formulas[metric], {n: F.col(f"m_{n}") for n in inputs})
        wide = wide.withColumn(f"f_{metric}", made).withColumn(f"m_{metric}", F.coalesce(f"f_{metric}", f"m_{metric}"))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"f_{m}").alias("value")) for m in order))
    return wide.select(*keys, F.inline(rows)).filter("value IS NOT NULL")

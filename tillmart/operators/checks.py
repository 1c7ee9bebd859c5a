"""Data-quality checks. Each ``check_*`` returns failing rows; ``run_checks`` returns one row per check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ROW_RULES = ("not_null", "accepted", "expression")


def check_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def check_unique(df: DataFrame, col: str) -> DataFrame:
    """Repeated values with their row count; NULLs are ignored."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def check_relationship(child: DataFrame, col: str, parent: DataFrame, field: str) -> DataFrame:
    """Child keys without a parent and their row count. Keys are counted first, so a frequent key moves once."""
    keys = child.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n_rows"))
    return keys.join(parent.select(F.col(field).alias(col)), col, "left_anti")


def check_accepted(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.filter(~F.col(col).isin(list(values)))


def check_expression(df: DataFrame, expr: str) -> DataFrame:
    """Rows for which the expression is false; NULL passes."""
    return df.filter(~F.expr(expr))


def _failing(rule: tuple) -> Column:
    kind = rule[0]
    if kind == "not_null":
        return F.col(rule[1]).isNull()
    if kind == "accepted":
        return ~F.col(rule[1]).isin(list(rule[2]))
    return ~F.expr(rule[1])


def rule_name(table: str, rule: tuple) -> str:
    return f"{table}: {rule[0]} {rule[1]}"


def run_checks(tables: dict[str, DataFrame], rules: dict[str, Sequence[tuple]]) -> DataFrame:
    """(check_name, failures) for every rule. All row rules of a table share one pass over it."""
    out: list[DataFrame] = []
    for table, table_rules in rules.items():
        df = tables[table]
        row_rules = [r for r in table_rules if r[0] in ROW_RULES]
        if row_rules:
            counted = df.agg(*[F.count_if(_failing(r)).alias(f"c{i}") for i, r in enumerate(row_rules)])
            out.append(counted.select(F.explode(F.array(*[
                F.struct(F.lit(rule_name(table, r)).alias("check_name"), F.col(f"c{i}").alias("failures"))
                for i, r in enumerate(row_rules)])).alias("r")).select("r.*"))
        for r in table_rules:
            if r[0] == "unique":
                bad = check_unique(df, r[1]).agg(F.count("*").alias("failures"))
            elif r[0] == "relationship":
                bad = (check_relationship(df, r[1], tables[r[2]], r[3])
                       .agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("failures")))
            else:
                continue
            out.append(bad.select(F.lit(rule_name(table, r)).alias("check_name"), "failures"))
    return reduce(DataFrame.unionByName, out)


class Watched:
    """Row rules counted on the rows of a table while they are written, instead of reading the table again."""

    def __init__(self, table: str, rules: Sequence[tuple]):
        self.table, self.rules = table, [r for r in rules if r[0] in ROW_RULES]
        self._seen: list[Observation] = []

    def watch(self, df: DataFrame) -> DataFrame:
        """``df``, counted by the next action on it. Put it right before the write, where each row passes once."""
        self._seen.append(Observation())
        return df.observe(self._seen[-1], F.count(F.lit(1)).alias("n_rows"),
                          *[F.count_if(_failing(r)).alias(f"c{i}") for i, r in enumerate(self.rules)])

    def n_rows(self) -> int:
        return sum(o.get["n_rows"] for o in self._seen)

    def failures(self) -> list[tuple[str, int]]:
        """(check_name, failures) over all writes."""
        return [(rule_name(self.table, r), sum(o.get[f"c{i}"] for o in self._seen)) for i, r in enumerate(self.rules)]


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """(table_name, n_rows, status) for each table; the status compares with the expected count where there is one."""
    expected = expected or {}
    out = []
    for name, df in tables.items():
        want = expected.get(name)
        status = F.lit("OK") if want is None else F.when(F.col("n_rows") == want, "OK").otherwise(
            f"WARN (expected {want})")
        out.append(df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows",
                                                               status.alias("status")))
    return reduce(DataFrame.unionByName, out)

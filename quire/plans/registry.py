"""Chains of named steps: what configuration files ask for, without evaluating names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[..., DataFrame]


class Registry:
    """Steps by name; unknown names and arguments are errors before anything runs."""

    def __init__(self) -> None:
        self._steps: dict[str, Step] = {}

    def add(self, name: str, step: Step) -> None:
        if name in self._steps:
            raise ValueError(f"{name} is registered already")
        self._steps[name] = step

    def plan(self, steps: list[dict[str, dict | None]], **common: object) -> Callable[[DataFrame], DataFrame]:
        """One function of a list of one-key mappings; ``common`` arguments override the steps' own."""
        chosen = []
        for entry in steps:
            if len(entry) != 1:
                raise ValueError(f"a step has one name: {entry}")
            ((name, own),) = entry.items()
            if name not in self._steps:
                raise KeyError(f"no step {name}; known: {', '.join(sorted(self._steps))}")
            chosen.append((self._steps[name], {**(own or {}), **common}))

        def run(df: DataFrame) -> DataFrame:
            for step, arguments in chosen:
                df = step(df, **arguments)
            return df

        return run


#: Rows of a task where each is dear.
TASK_ROWS = 1 << 16


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as there are cores, and as their number asks for: a file is a few tasks, however dear its rows are."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def page_tasks(rows: DataFrame) -> int:
    """How many tasks ``rows`` are dealt to by page: the session's, or more where their number asks for more."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def rounded(value: Column, places: int) -> Column:
    """A double rounded as SQL engines do that round it times a power of ten; ``round`` goes by its decimal digits, and they differ next to halves."""
    return F.round(value * F.lit(10.0**places)) / F.lit(10.0**places)


def registered() -> tuple[dict, dict, Callable]:
    """Queries and their SQL by name, and the decorator that puts them there."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(name: str, says: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            queries[name] = f
            if says:
                sql[name] = says
            return f

        return put

    return queries, sql, query

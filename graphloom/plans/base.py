"""The tables of registered queries and of their SQL, and the decorator that fills them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.workload import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
A, B = "Brand#11", "Brand#12"


def query(sql: str | None = None, ctes: str = ""):
    """Register a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = (f"WITH RECURSIVE {ctes.strip()} " if ctes else "") + sql.replace("{A}", A).replace("{B}", B)
        return f

    return add


def long(c: str) -> Column:
    return F.col(c).cast("long")

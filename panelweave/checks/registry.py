"""Queries with their oracle SQL.

``columns`` names the compared columns once for both engines: ``x`` as is, ``x~`` a double rounded
to six places (``x~3`` to three), ``x#`` an integer, ``x@`` text (dates), ``x?`` a flag as 0/1.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.views import Views
from .ctes import CTES

_SPEC = re.compile(r"(\w+)([~#@?]?)(\d*)")


@dataclass(frozen=True)
class Check:
    name: str
    columns: str
    build: Callable[[Views], DataFrame]
    body: str | None

    def _specs(self):
        return [_SPEC.fullmatch(c).groups() for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Views(spark, sf_dir))
        out = []
        for name, kind, digits in self._specs():
            c = F.col(name)
            if kind == "~":
                c = F.round(c.cast("double"), int(digits or 6)) + F.lit(0.0)
            elif kind == "#":
                c = c.cast("bigint")
            elif kind == "@":
                c = c.cast("string")
            elif kind == "?":
                c = c.cast("int")
            out.append(c.alias(name))
        return df.select(*out)

    def sql(self) -> str | None:
        if self.body is None:
            return None
        out = []
        for name, kind, digits in self._specs():
            c = f'"{name}"'
            c = {"~": f"round(CAST({c} AS DOUBLE), {digits or 6}) + CAST(0 AS DOUBLE)", "#": f"CAST({c} AS BIGINT)",
                 "@": f"CAST({c} AS VARCHAR)", "?": f"CAST({c} AS INTEGER)"}.get(kind, c)
            out.append(f'{c} AS "{name}"')
        needed = _closure(self.body)
        ctes = [f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in needed] + [f"result AS ({self.body.strip()})"]
        return f"WITH RECURSIVE {', '.join(ctes)} SELECT {', '.join(out)} FROM result"


def _mentions(text: str) -> set[str]:
    return set(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)) & CTES.keys()


def _closure(body: str) -> list[str]:
    """Shared CTEs the text needs, each after those it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in out:
            for dep in sorted(_mentions(CTES[name]) - {name}):
                visit(dep)
            out.append(name)

    for n in sorted(_mentions(body)):
        visit(n)
    return out


CHECKS: dict[str, Check] = {}


def check(name: str, columns: str, build: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    if name in CHECKS:
        raise ValueError(f"duplicate check {name}")
    CHECKS[name] = Check(name, columns, build, sql)

"""Selection of contracts: filters, sorts with nulls last in both directions, paging and bounded top-k."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fold_text

PAGE_SIZES = (25, 50, 100, 250)


@dataclass
class ViewSpec:
    """What a view shows; text round-trips through ``encode`` and ``decode``."""

    country: str = ""
    date_from: str = ""
    date_to: str = ""
    search: str = ""
    minimum: float = 0.0
    min_score: float = 0.0
    sort: str = "score"
    page: int = 1
    size: int = 50
    equals: dict = field(default_factory=dict)

    def encode(self) -> str:
        plain = {k: v for k, v in self.__dict__.items() if k != "equals" and v != ViewSpec.__dataclass_fields__[k].default}
        return urlencode({**plain, **{f"eq.{k}": v for k, v in self.equals.items()}})

    @classmethod
    def decode(cls, text: str) -> "ViewSpec":
        out = cls()
        for k, v in parse_qsl(text):
            if k.startswith("eq."):
                out.equals[k[3:]] = v
            elif k in cls.__dataclass_fields__:
                setattr(out, k, type(getattr(out, k))(v))
        out.size = min(PAGE_SIZES, key=lambda s: abs(s - out.size))
        out.page = max(1, out.page)
        return out


def predicates(spec: ViewSpec, search_columns: list[str]) -> list[Column]:
    out = [F.col(k) == v for k, v in spec.equals.items()]
    if spec.country:
        out.append(F.col("country") == spec.country)
    if spec.date_from:
        out.append(F.col("date") >= spec.date_from)
    if spec.date_to:
        out.append(F.col("date") <= spec.date_to)
    if spec.minimum > 0:
        out += [F.col("amount") > 0, F.col("amount") >= spec.minimum]
    if spec.min_score > 0:
        out.append(F.col("score") >= spec.min_score)
    text = fold_text(F.concat_ws(" ", *search_columns)) if search_columns else None
    for term in spec.search.split():
        out.append(text.contains(fold_text(F.lit(term))))
    return out


def orders(sort: str) -> list[Column]:
    """Sort keys of a mode such as ``amount`` (descending) or ``amount-asc``; then score, families and id."""
    name, _, way = sort.partition("-")
    first = F.col(name).asc_nulls_last() if way == "asc" or name in ("buyer", "supplier") and way != "desc" else F.col(name).desc_nulls_last()
    return [first, F.coalesce("score", F.lit(-1)).desc(), F.col("id").asc_nulls_last()]


def select(contracts: DataFrame, spec: ViewSpec, search_columns: list[str] | None = None) -> DataFrame:
    found = reduce(DataFrame.where, predicates(spec, search_columns or []), contracts)
    return found.orderBy(*orders(spec.sort)).offset((spec.page - 1) * spec.size).limit(spec.size)


def top(contracts: DataFrame, k: int) -> DataFrame:
    return contracts.orderBy(F.col("score").desc_nulls_last(), F.col("amount").desc_nulls_last(), "id").limit(k)

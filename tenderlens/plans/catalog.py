"""Registered queries of the screening engine and their SQL oracles."""

from __future__ import annotations

import re

from .dialect import Duck, Spark
from .screening import PLANS

FLAGSHIP = "m0_screening_index"


def _doubles(sql: str) -> str:
    """Literals with a point are meant as doubles, in either engine."""
    return re.sub(r"(?<![\w'./])(\d+\.\d+)(?![\w'./])", r"\1e0", sql)


def _query(plan):
    def run(spark, sf_dir):
        # the oracle's spelling never reaches Spark: the plan is made for the folder that is read
        return spark.sql(_doubles(plan(Spark("\0"))).replace("\0", sf_dir))

    run.__name__, run.__doc__ = plan.__name__, plan.__doc__
    return run


QUERIES: dict = {name: _query(p) for name, p in PLANS.items()}
ORACLES: dict = {name: _doubles(p(Duck())) for name, p in PLANS.items()}

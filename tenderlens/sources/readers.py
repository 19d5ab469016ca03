"""Readers of contract data: user CSV files, JSON lists, open-contracting releases, namespaced XML notices, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which user files give a field.
ALIASES = {"id": ["id", "contract id", "reference"], "buyer": ["buyer", "authority"], "description": ["description", "title", "object"], "amount": ["amount", "value"], "offers": ["offers", "bids"]}


def sniff_separator(header: str) -> str:
    """The more frequent of ; and , outside quotes."""
    bare = "".join(part for i, part in enumerate(header.split('"')) if i % 2 == 0)
    return ";" if bare.count(";") > bare.count(",") else ","


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A user's CSV: byte-order mark, quoted and multi-line cells; aliases map to the record's names; malformed rows raise."""
    header = spark.read.text(path).limit(1).first()
    sep = sniff_separator(header[0] if header else "")
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="FAILFAST")
    names = {c: c.lstrip("﻿").strip().lower() for c in df.columns}
    if len(set(names.values())) < len(names):
        raise ValueError("two columns have one name")
    found = {field: next((c for c, n in names.items() if n in aliases), None) for field, aliases in ALIASES.items()}
    missing = [f for f in ("id", "buyer", "description") if not found[f]]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    cols = [F.trim(F.col(f"`{c}`")).alias(f) for f, c in found.items() if c]
    out = df.select(*cols).where(F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in ("id", "buyer", "description")]).isNotNull())
    for f, kind in (("amount", "double"), ("offers", "int")):
        if f in out.columns:
            out = out.withColumn(f, F.nullif(F.col(f), F.lit("")).cast(kind))
    return out


RELEASE = """ocid string, date string, buyer struct<id:string,name:string>, tender struct<procurementMethod:string,numberOfTenderers:int,title:string>,
parties array<struct<id:string,name:string>>, awards array<struct<id:string,date:string,status:string,value:struct<amount:double,currency:string>,suppliers:array<struct<id:string,name:string>>>>"""


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each active award of open-contracting releases (a file holds one package)."""
    raw = spark.read.schema(f"releases array<struct<{','.join(_fields())}>>").option("multiLine", True).json(path)
    r = raw.select(F.explode("releases").alias("r")).select("r.*")
    return r.select("ocid", "buyer", "tender", F.explode("awards").alias("a")).where("a.status is null or a.status = 'active'").select(
        F.concat_ws("-", "ocid", "a.id").alias("id"), "ocid", F.col("buyer.name").alias("buyer"), F.col("tender.title").alias("description"),
        F.col("tender.procurementMethod").alias("procedure"), F.col("tender.numberOfTenderers").alias("offers"), F.col("a.value.amount").alias("amount"),
        F.col("a.value.currency").alias("currency"), F.col("a.date").alias("date"),
        F.when(F.size("a.suppliers") == 1, F.col("a.suppliers")[0]["id"]).alias("supplier_id"),
    )


def _fields() -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(RELEASE).fields]


def read_notices(spark: SparkSession, path: str, row_tag: str = "cac:LotResult") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)

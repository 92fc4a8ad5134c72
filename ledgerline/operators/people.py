"""People known beforehand: a registry table that speakers and recipients are resolved against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import or_else
from ledgerline.sources.sinks import settled

#: Most registry rows that are broadcast; a larger registry is joined by shuffle.
BROADCAST_ROWS = 100_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """A registry's keys for a join: broadcast, or a table of its own.

    Many rows have one key (or none).  Spark splits such a key's rows only where both sides of the join are plain shuffles, not
    where one is an aggregate that lies there as the join needs it.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else settled(df)


def keys_of(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A registry's rows by address and by name, both trimmed and in lower case; made once for all that is resolved against it."""
    rows = registry.count()
    known = F.struct("canonical_id", "name", "org")
    by_mail = registry.select(F.explode("emails").alias("_reg_key"), known.alias("_reg_row")).groupBy(F.lower(F.trim("_reg_key")).alias("_reg_mail_key")).agg(F.min("_reg_row").alias("_reg_by_mail"))
    by_name = registry.groupBy(F.lower(F.trim("name")).alias("_reg_name_key")).agg(F.min(known).alias("_reg_by_name"))
    return _sized(by_mail, rows), _sized(by_name, rows)


def resolved(df: DataFrame, registry: DataFrame | tuple[DataFrame, DataFrame], email: str, name: str, prefix: str = "person") -> DataFrame:
    """Add <prefix>_name, <prefix>_org and <prefix>_resolved: by address first, then by name, both trimmed and in lower case.

    A miss keeps the row's own name and gets the organisation "Unknown".  Of a key that the registry lists
    twice, the smallest canonical id counts.  ``registry``: the table, or its ``keys_of``.
    """
    by_mail, by_name = registry if isinstance(registry, tuple) else keys_of(registry)
    out = df.join(by_mail, F.lower(F.trim(email)) == F.col("_reg_mail_key"), "left").join(by_name, F.lower(F.trim(name)) == F.col("_reg_name_key"), "left")
    hit = F.coalesce("_reg_by_mail", "_reg_by_name")
    out = out.withColumn(f"{prefix}_name", F.coalesce(hit["name"], F.col(name))).withColumn(f"{prefix}_org", F.coalesce(hit["org"], F.lit("Unknown"))).withColumn(f"{prefix}_resolved", hit.isNotNull())
    return out.drop("_reg_mail_key", "_reg_name_key", "_reg_by_mail", "_reg_by_name")


def listed(text: Column) -> Column:
    """Recipients of a header line: array of (name, email) from parts between semicolons; email is null without an address."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    shape = r"^([^<]+?)\s*<([^>]+)>\s*$"
    return F.transform(
        parts,
        lambda p: F.struct(
            or_else(F.trim(F.regexp_extract(p, shape, 1)), p).alias("name"),
            F.nullif(F.trim(F.regexp_extract(p, shape, 2)), F.lit("")).alias("email"),
        ),
    )

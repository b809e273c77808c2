"""B9 / B10 in one shuffle per key domain, also for a load that comes on top of stored rows.

A key domain is a parent column and all columns that refer to it: the merchant ids, the item ids, the
order ids. All rows of a domain are united as (key, role) and counted per key in one aggregate, which
has a map-side part, so a key in a third of all rows is one row per task and one exchange answers every
unique and foreign-key check of the domain. A new load is united with the stored keys alone: the
keys of the stored parents, and nothing of the stored children, which were checked when they came.

Null keys break no unique or foreign-key rule, as in SQL. Keys are compared as text within a domain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.sources import schemas as S


@dataclass
class Domain:
    """The columns that share one set of keys."""
    parent: str
    column: str
    unique: bool = False
    children: list[tuple[str, str]] = field(default_factory=list)


def domains(unique: dict[str, list[str]] = S.UNIQUE_KEYS, foreign: list[tuple[str, str, str, str]] = S.FOREIGN_KEYS) -> list[Domain]:
    """The declared constraints, grouped by the column that holds the keys."""
    out: dict[tuple[str, str], Domain] = {}
    for name, keys in unique.items():
        table, column = name.split("#")[0], ",".join(keys)
        out.setdefault((table, column), Domain(table, column)).unique = True
    for child, child_column, parent, column in foreign:
        out.setdefault((parent, column), Domain(parent, column)).children.append((child, child_column))
    return list(out.values())


def _keys(df: DataFrame, column: str, role: int) -> DataFrame:
    parts = column.split(",")
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in parts))
    key = F.col(column).cast("string") if len(parts) == 1 else F.to_json(F.struct(*parts))
    return rows.select(key.alias("key"), F.lit(role).alias("role"))


def audit_domain(domain: Domain, tables: dict[str, DataFrame], stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """(check, duplicated_keys, violations) of one domain: surplus rows of its unique column, and rows of each child without parent.

    ``tables`` are the rows to check, ``stored`` (distinct rows that were checked before) what they come on top of."""
    united = _keys(tables[domain.parent], domain.column, 0)
    if stored and domain.parent in stored:
        united = united.unionByName(_keys(stored[domain.parent], domain.column, 1))
    children = [(t, c) for t, c in domain.children if t in tables]
    for k, (table, column) in enumerate(children):
        united = united.unionByName(_keys(tables[table], column, 2 + k))
    per_key = united.groupBy("key").agg(*(F.count_if(F.col("role") == r).alias(f"n{r}") for r in range(2 + len(children))))
    new, old = F.col("n0"), F.col("n1")
    surplus = F.when(new > 0, new + F.least(old, F.lit(1)) - 1).otherwise(0)
    sums = [F.count_if(surplus > 0).alias("d"), F.coalesce(F.sum(surplus), F.lit(0)).alias("s")]
    sums += [F.coalesce(F.sum(F.when(new + old == 0, F.col(f"n{2 + k}"))), F.lit(0)).alias(f"o{k}") for k in range(len(children))]
    row = per_key.agg(*sums)
    checks = [F.struct(F.lit(f"unique {domain.parent}:{domain.column}").alias("check"), F.col("d").alias("duplicated_keys"),
                       F.col("s").cast("long").alias("violations"))] if domain.unique else []
    checks += [F.struct(F.lit(f"fk {t}.{c}->{domain.parent}.{domain.column}").alias("check"), F.lit(None).cast("long").alias("duplicated_keys"),
                        F.col(f"o{k}").cast("long").alias("violations")) for k, (t, c) in enumerate(children)]
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def audit_keys(tables: dict[str, DataFrame], stored: dict[str, DataFrame] | None = None, declared: list[Domain] | None = None) -> DataFrame:
    """All unique and foreign-key checks whose parent table is given, one exchange per key domain."""
    found = [audit_domain(d, tables, stored) for d in declared or domains() if d.parent in tables]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out

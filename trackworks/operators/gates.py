"""Checks that fail loudly: each finds violating rows and raises if there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A table breaks a rule; the message has the rule and one row."""


def require_none(df: DataFrame, rule: str) -> None:
    """Raises if df has a row; reads no further than the first."""
    found = df.limit(1).collect()
    if found:
        raise GateError(f"{rule}: {found[0].asDict()}")


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have."""
    return df.groupBy(*keys).count().filter("count > 1")


def absent(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null in one of the columns."""
    return df.filter(F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x))


def unknown(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Non-null keys of df, a row each, that dim hasn't."""
    return df.filter(F.col(key).isNotNull()).select(key).join(dim.select(F.col(dim_key or key).alias(key)).distinct(), key, "left_anti")


def not_constant(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Keys whose rows have several values in a column; nulls don't count."""
    return df.groupBy(*keys).agg(F.min(column).alias("least"), F.max(column).alias("most")).filter("least <> most")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    require_none(not_unique(df, *keys), f"{', '.join(keys)} must be unique")
    return df


def require_present(df: DataFrame, *columns: str) -> DataFrame:
    require_none(absent(df, *columns), f"{', '.join(columns)} must not be null")
    return df


def require_known(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Each non-null key of df must be in dim."""
    require_none(unknown(df, dim, key, dim_key), f"{key} must be known")
    return df


def require_constant(df: DataFrame, column: str, *keys: str) -> DataFrame:
    require_none(not_constant(df, column, *keys), f"{column} must be constant by {', '.join(keys)}")
    return df


def require_matched(rules: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Each rule must fit at least one row of df; a null in a rule's key fits any value."""
    require_none(unmatched(rules, df, keys), f"each rule on {', '.join(keys)} must match a row")
    return df


def unmatched(rules: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rules that fit no row of df, by equality of their non-null keys: a semi-join for each set of keys that rules have."""
    named = rules.withColumn("_given", F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys])))
    left = None
    for given in named.select("_given").distinct().collect():  # as many as there are shapes of rules, at most 2 ** keys
        own = named.filter(F.col("_given") == F.array(*[F.lit(k) for k in given[0]]).cast("array<string>")).drop("_given")
        own = own.join(df.select(*given[0]).distinct(), given[0], "left_anti") if given[0] else own.filter(F.lit(df.isEmpty()))
        left = own if left is None else left.unionByName(own)
    return left if left is not None else rules.limit(0)


def constraint_report(**broken: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule, given the rows that do; 0 where it holds."""
    found = None
    for rule, df in broken.items():
        n = df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
        found = n if found is None else found.unionByName(n)
    return found


def violations(df: DataFrame, keys: list[str], **rules: Column) -> DataFrame:
    """How many rows break each rule, by keys; a rule that gives null isn't broken."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in rules.items()])


def version_diff(old: DataFrame, new: DataFrame, key: str, expected_gone: DataFrame) -> DataFrame:
    """(key, status): removed, added, unexpected (removed but not in expected_gone), still_present (expected_gone, not removed).

    One full join on the key, whatever the number of sets.
    """
    sides = [x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((old, "o"), (new, "n"), (expected_gone, "e"))]
    j = sides[0].join(sides[1], key, "full").join(sides[2], key, "full")
    o, n, e = (F.coalesce(F.col(c), F.lit(False)) for c in "one")
    status = F.array_compact(F.array(F.when(o & ~n, "removed"), F.when(n & ~o, "added"), F.when(o & ~n & ~e, "unexpected"), F.when(e & n, "still_present")))
    return j.select(key, F.explode(status).alias("status"))


def changed_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(column, n_changed) over rows that both have; nulls are equal to nulls."""
    cols = [c for c in a.columns if c != key]
    x = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in cols]).join(b.select(key, *[F.col(c).alias(f"_b_{c}") for c in cols]), key)
    one = x.agg(*[F.count_if(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(c) for c in cols])
    return one.select(F.explode(F.create_map(*[y for c in cols for y in (F.lit(c), F.col(c))])).alias("column", "n_changed"))


def leaf_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, allowed: Column) -> DataFrame:
    """Keyed leaves of two versions: verdict pass (a declared change), unexpected or unchanged; absent leaves are null."""
    x = a.select(*keys, F.col(value).alias("was")).join(b.select(*keys, F.col(value).alias("now")), keys, "full")
    same = F.col("was").eqNullSafe(F.col("now"))
    return x.withColumn("verdict", F.when(same, "unchanged").when(allowed, "pass").otherwise("unexpected"))

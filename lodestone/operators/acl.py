"""Who may see what: path-prefix lists, longest-prefix snapshots, roles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas

MOST_ENTRIES = 10_000


def acl_table(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """Authorised (repository, path prefix) pairs. An empty list is an error, never "all"; so is an unclean path."""
    if not 1 <= len(entries) <= MOST_ENTRIES:
        raise ValueError(f"1 to {MOST_ENTRIES} entries")
    clean = []
    for repository, prefix in entries:
        prefix = unicodedata.normalize("NFC", prefix).rstrip("/")
        if prefix.startswith("/") or "\\" in prefix or any(p in ("", ".", "..") for p in prefix.split("/") if prefix):
            raise ValueError(f"invalid path {prefix!r}")
        clean.append((repository.lower(), prefix))
    if len(set(clean)) < len(clean):
        raise ValueError("duplicate entries")
    return spark.createDataFrame(sorted(clean), schemas.ACL)


def under(path: Column, prefix: Column) -> Column:
    """``path`` is ``prefix`` or below it; the slash keeps ``Source`` from matching ``Source2``."""
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def own_prefixes(path: Column) -> Column:
    """All prefixes that cover ``path``, itself included; a null path is covered by the empty one."""
    parts = F.split(path, "/")
    own = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.coalesce(F.array_distinct(own), F.array(F.lit("")))


def least_entries(acl: DataFrame) -> DataFrame:
    """``acl`` without entries that another one of the repository covers: no row meets two of what is left."""
    own = acl.select("repository_id", "path_prefix").distinct()
    above = own.select("repository_id", "path_prefix", F.explode(own_prefixes(F.col("path_prefix"))).alias("above")).where("above <> path_prefix")
    covered = above.join(own.select("repository_id", F.col("path_prefix").alias("above")), ["repository_id", "above"]).select("repository_id", "path_prefix").distinct()
    return own.join(covered, ["repository_id", "path_prefix"], "left_anti")


def visible(rows: DataFrame, acl: DataFrame, repository: str = "repository_id", path: str = "path", optional: bool = False) -> DataFrame:
    """Rows that an entry of ``acl`` covers; with ``optional``, also rows without a path.

    A row meets the entries by its own prefixes, on equality, whatever the number of entries; as these cover each other no
    more, it meets one at most. They are broadcast if they are no more than MOST_ENTRIES.
    """
    entries = least_entries(acl).select(F.col("repository_id").alias("_r"), F.col("path_prefix").alias("_p"))
    if acl.limit(MOST_ENTRIES + 1).count() <= MOST_ENTRIES:
        entries = F.broadcast(entries)
    cut = lambda df: df.withColumn("_own", F.explode(own_prefixes(F.col(path))))
    seen = lambda df: cut(df).join(entries, (F.col(repository) == F.col("_r")) & (F.col("_own") == F.col("_p"))).select(*rows.columns)
    if not optional:
        return seen(rows)
    return rows.where(F.col(path).isNull()).unionByName(seen(rows.where(F.col(path).isNotNull())))


def longest_prefix(rows: DataFrame, prefixes: DataFrame, key: str, path: str, prefix: str, value: str) -> DataFrame:
    """Per row of ``rows`` (``key``, ``path``) the ``value`` of the longest prefix that covers it; null where none does.

    Every path is cut into its own prefixes, so the join is on equality and needs no nested loop, whatever the sizes.
    """
    cut = rows.where(F.col(path).isNotNull()).select(key, F.explode(own_prefixes(F.col(path))).alias(prefix))
    best = cut.join(prefixes.select(prefix, value), prefix).groupBy(key).agg(F.max_by(F.struct(prefix, value), F.length(prefix)).alias("_best"))
    return rows.join(best, key, "left").select(*rows.columns, F.col(f"_best.{prefix}").alias(prefix), F.col(f"_best.{value}").alias(value))


def strongest_role(permissions: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, role) from permissions (principal_type, principal_id, role) held directly or through a team."""
    rank = F.array_position(F.array(*map(F.lit, schemas.ROLES)), F.col("role"))
    direct = permissions.where("principal_type = 'user'").select(F.col("principal_id").alias("user_id"), "role")
    team = permissions.where("principal_type = 'team'").join(memberships.withColumnRenamed("team_id", "principal_id"), "principal_id").select("user_id", "role")
    return direct.unionByName(team).groupBy("user_id").agg(F.max_by("role", rank).alias("role"))


def fresh(snapshots: DataFrame, now: Column, most_age_s: int) -> DataFrame:
    """Snapshots that are neither expired nor older than ``most_age_s`` at ``now``."""
    return snapshots.where((F.col("expires_at") > now) & (F.col("captured_at") <= now) & (F.unix_seconds(now) - F.unix_seconds(F.col("captured_at").cast("timestamp")) <= most_age_s))


def captured_access(probes: DataFrame) -> DataFrame:
    """Probe results (path, code, error) as access: readable, none for authorisation errors, indeterminate for others."""
    denied = F.col("error").rlike("(?i)E170001|E175013|forbidden|unauthori[sz]ed")
    access = F.when(F.col("error").isNull(), F.lit("read")).when(denied, F.lit("none")).otherwise(F.lit("indeterminate"))
    return probes.withColumn("access", access).withColumn("complete", F.col("access") != "indeterminate")

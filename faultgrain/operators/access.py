"""Who may see what: roles, tokens, project scope, audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Permissions of the built-in roles.
ROLES: dict[str, tuple[str, ...]] = {
    "owner": (
        "event:read", "event:admin", "issue:read", "issue:write", "project:read", "project:write", "project:admin", "member:read",
        "member:write", "team:write", "org:read", "org:write", "alerts:write", "token:admin", "audit:read", "ops:read",
    ),
    "manager": (
        "event:read", "event:admin", "issue:read", "issue:write", "project:read", "project:write", "project:admin", "member:read",
        "member:write", "team:write", "org:read", "alerts:write", "ops:read",
    ),
    "admin": ("event:read", "issue:read", "issue:write", "project:read", "project:write", "member:read", "org:read", "alerts:write", "ops:read"),
    "member": ("event:read", "issue:read", "issue:write", "project:read", "org:read", "ops:read"),
    "billing": ("org:read",),
    "read_only": ("issue:read", "project:read", "org:read", "ops:read"),
}
AUDIT_LIMIT, AUDIT_MOST = 200, 1000


def role_permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, list(p)) for r, p in ROLES.items()], "role string, role_permissions array<string>")


def restrict(granted, allowed):
    """Permissions of an identity that carries a subset: those in both sets, or all granted if the subset is empty."""
    return F.when(F.size(F.coalesce(allowed, F.array().cast("array<string>"))) == 0, granted).otherwise(F.array_intersect(granted, allowed))


def effective_permissions(users: DataFrame, tokens: DataFrame, now_ns: int) -> DataFrame:
    """(token_id, user_id, org_id, permissions) of tokens that are neither revoked nor expired; unknown roles have none."""
    live = tokens.where(~F.col("revoked") & ((F.col("expires_at") == 0) | (F.col("expires_at") > now_ns)))
    live = live.select(F.col("id").alias("token_id"), "user_id", F.col("permissions").alias("allowed"))
    roles = role_permissions(users.sparkSession)  # six rows
    granted = users.select("user_id", "org_id", "role").join(F.broadcast(roles), "role", "left")
    granted = granted.withColumn("role_permissions", F.coalesce("role_permissions", F.array().cast("array<string>")))
    both = live.join(granted, "user_id")
    return both.select("token_id", "user_id", "org_id", F.array_sort(restrict(F.col("role_permissions"), F.col("allowed"))).alias("permissions"))


def scoped_view(table: DataFrame, projects: DataFrame, org_id: int, permissions: set[str] | tuple[str, ...]) -> DataFrame:
    """Rows of the organisation's projects; without event:read the payload is null, without project:read there are none."""
    allowed = projects.where((F.col("org_id") == org_id) & F.lit("project:read" in permissions)).select(F.col("id").alias("project_id"))
    out = table.join(allowed, "project_id", "left_semi")
    if "payload" in table.columns and "event:read" not in permissions:
        out = out.withColumn("payload", F.lit(None).cast(table.schema["payload"].dataType))
    return out


def in_org(project_ids: DataFrame, projects: DataFrame, org_id: int) -> DataFrame:
    """Those of ``project_ids(project_id)`` that belong to the organisation."""
    return project_ids.join(projects.where(F.col("org_id") == org_id).select(F.col("id").alias("project_id")), "project_id", "left_semi")


def project_list(projects: DataFrame, keys: DataFrame, org_id: int) -> DataFrame:
    """The organisation's projects with their first active key, or ''."""
    first = keys.where("is_active").groupBy(F.col("project_id").alias("id")).agg(F.min_by("public_key", "id").alias("public_key"))
    own = projects.where(F.col("org_id") == org_id).join(first, "id", "left")
    return own.withColumn("public_key", F.coalesce("public_key", F.lit("")))


def append_audit(entries: DataFrame, path: str) -> None:
    """Add rows (at, org_id, user_id, action, target) to the trail; rows are never changed."""
    entries.write.mode("append").parquet(path)


def audit_trail(audit: DataFrame, org_id: int, limit: int = 0) -> DataFrame:
    """The organisation's newest entries; at most ``limit`` (200 if not in 1 to 1000)."""
    return audit.where(F.col("org_id") == org_id).orderBy(F.desc("at"), F.desc("id")).limit(limit if 0 < limit <= AUDIT_MOST else AUDIT_LIMIT)

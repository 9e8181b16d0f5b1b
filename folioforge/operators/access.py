"""Who may see what: document filters, access rules and the split of rows into an accessible and a denied side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The highest level that each role may read, and the names of a place that fit every place.
ROLE_LEVELS = {"admin": 4, "developer": 4, "manager": 3, "employee": 2}
ANY_CITY = ["", "未知", "通用", "全国", "不限"]
PROJECT_CATEGORY = "项目资料"


def city_fits(document: Column, asked: Column) -> Column:
    plain = [F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "市$", "") for c in (document, asked)]
    return plain[0].isin(*ANY_CITY) | plain[1].isin(*ANY_CITY) | (plain[0] == plain[1])


def searchable(city: Column, asked: Column) -> Column:
    return F.coalesce(F.col("enabled") & (F.col("status") == "indexed") & city_fits(city, asked), F.lit(False))


def may_view(user: str = "user", document: str = "document") -> Column:
    """The access rule. user: id, role, project_ids, owned_project_ids; document: project_id, project_owner_id, category, accessible_user_ids, permission_level.

    A null access list and an empty one differ: only without a list do members of the project get in. Unknown roles see nothing.
    """
    u, d = (lambda name: F.col(f"{user}.{name}")), (lambda name: F.col(f"{document}.{name}"))
    level = F.coalesce(*[F.when(u("role") == role, F.lit(most)) for role, most in ROLE_LEVELS.items()])
    in_project = d("project_id").isNotNull() | d("project_owner_id").isNotNull() | F.coalesce(d("category") == PROJECT_CATEGORY, F.lit(False))

    def has(array: Column, value: Column) -> Column:
        return F.coalesce(F.array_contains(array, value), F.lit(False))

    listed = F.coalesce(d("project_owner_id") == u("id"), F.lit(False)) | (u("id").isNotNull() & has(d("accessible_user_ids"), u("id")))
    member = d("project_id").isNotNull() & d("accessible_user_ids").isNull() & has(u("project_ids"), d("project_id"))
    owned = d("project_id").isNotNull() & d("project_owner_id").isNull() & has(u("owned_project_ids"), d("project_id"))
    by_project = listed | member | owned
    by_level = F.coalesce(F.coalesce(d("permission_level"), F.lit(1)) <= level, F.lit(False))
    return F.when(level.isNull(), False).when(u("role").isin("admin", "developer"), True).when(in_project, by_project).otherwise(by_level)


def may_manage(user: str = "user", document: str = "document") -> Column:
    u, d = (lambda name: F.col(f"{user}.{name}")), (lambda name: F.col(f"{document}.{name}"))
    owner = F.coalesce(d("project_owner_id") == u("id"), F.lit(False))
    owned = d("project_owner_id").isNull() & F.coalesce(F.array_contains(u("owned_project_ids"), d("project_id")), F.lit(False))
    return F.when(u("role").isin("admin", "developer"), True).when(u("role") == "manager", owner | owned).otherwise(False)


def resolved_users(asked: DataFrame, users: DataFrame) -> DataFrame:
    """asked (user_id) with the user's row; an unknown id gets no role, so that every rule denies it."""
    return asked.join(users, asked["user_id"] == users["id"], "left")


def split_by_access(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """rows with ``side``: accessible or denied, by the Boolean ``allowed`` of rules; rows of unknown keys are dropped."""
    return rows.join(rules.select(key, "allowed"), key).withColumn("side", F.when(F.col("allowed"), "accessible").otherwise("denied")).drop("allowed")

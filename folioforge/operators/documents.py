"""Rules for documents as a service keeps them: uploads, patches, deletion, labels of kinds, and what a user sees of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.rules import trimmed

#: Kinds of files, pages of the service, kinds of records and of their chunks.
FILE_TYPES = ["项目资料", "规划法规", "技术标准", "设计指引", "成果要求", "企业制度", "流程指引", "FAQ", "IT与行政", "财务与报销", "审查报批", "图纸图则", "技术规定", "用地分类", "控规导则", "停车标准", "公共服务设施标准", "其他"]
PAGES = [("/", "primary"), ("/documents", "primary"), ("/chunks", "developer"), ("/debug", "developer"), ("/evaluation", "developer")]
CHUNK_TYPES = {
    "regulation_clause": "clause", "clause_explanation": "clause_explanation", "definition": "definition", "structured_table": "table_full", "structured_table_row": "table_row", "classification_code": "code", "indicator_item": "indicator",
    "requirement": "requirement", "deliverable_requirement": "deliverable", "drawing_requirement": "deliverable", "procedure_step": "procedure", "checklist_item": "list_item",
}
#: What a search over both sides of the access rules means.
RISKS = ["仅命中无权资料，应返回权限提示", "命中无权资料，已在检索前隔离", "未找到可用依据，应触发依据不足判断", "仅命中可访问资料，可进入证据判断"]


def uploaded(rows: DataFrame) -> DataFrame:
    """rows (file_type, permission_level, effective_date as text, role, user_id) as documents are kept.

    Unknown types are others, levels other than 2 and 3 are 1, dates in another form are left out, managers own what they upload.
    """
    return rows.select(
        "*",
        F.when(trimmed(F.col("file_type")).isin(*FILE_TYPES), trimmed(F.col("file_type"))).otherwise("其他").alias("kept_type"),
        F.when(F.col("permission_level").isin(2, 3), F.col("permission_level")).otherwise(1).alias("kept_level"),
        F.when(F.col("effective_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("effective_date")).alias("kept_date"),
        F.when(F.col("role") == "manager", F.col("user_id")).alias("owner_id"),
        F.lit("pending").alias("status"),
    )


def patched_access(known: list[str]) -> Column:
    """The access list after a patch: known users of the patch (else the list as it was), and always the owner.

    patch_ids, ids: arrays or null; patch_owner: text, empty to take the owner away; owner_id.
    """
    users = F.array(*[F.lit(u) for u in known])
    chosen = F.when(F.col("patch_ids").isNotNull(), F.filter("patch_ids", lambda i: F.array_contains(users, i))).otherwise(F.col("ids"))
    fits = F.col("patch_owner").isNotNull() & ((F.col("patch_owner") == "") | F.array_contains(users, F.col("patch_owner")))
    owner = F.nullif(F.when(fits, F.col("patch_owner")).otherwise(F.col("owner_id")), F.lit(""))
    none = F.array().cast("array<string>")
    return F.when(owner.isNotNull(), F.array_union(F.coalesce(chosen, none), F.array(owner))).otherwise(chosen)


def removed(documents: DataFrame, gone: DataFrame, *dependants: DataFrame) -> list[DataFrame]:
    """documents without the ids of gone (doc_id), and the dependants (with doc_id) without theirs: chunks, tables, feedback."""
    return [df.join(gone.select("doc_id"), "doc_id", "left_anti") for df in (documents, *dependants)]


def sees_page(role: Column, kind: Column) -> Column:
    return (kind == "primary") | role.isin("admin", "developer")


def chunk_type(object_type: Column) -> Column:
    out = F.lit("section")
    for name, value in CHUNK_TYPES.items():
        out = F.when(object_type == name, value).otherwise(out)
    return out


def chunk_role(object_type: Column) -> Column:
    """Fallback for plain sections, parent for tables, else atomic."""
    return F.when(object_type == "plain_section", "fallback").when(object_type == "structured_table", "parent").otherwise("atomic")


def risk(accessible: Column, denied: Column) -> Column:
    return F.when((denied > 0) & (accessible == 0), RISKS[0]).when(denied > 0, RISKS[1]).when(accessible == 0, RISKS[2]).otherwise(RISKS[3])


def search_summary(hits: DataFrame, documents: DataFrame, by: str) -> DataFrame:
    """by, hits of both sides, their distinct documents in order of rank, and the risk.

    hits: by, rank, doc_id, file_name, accessible. A document's own name counts before that of the hit.
    """
    named = hits.join(documents.select("doc_id", F.col("file_name").alias("own_name")), "doc_id", "left").withColumn("name", F.coalesce("own_name", "file_name"))
    first = named.groupBy(by, "accessible", "name").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    names = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("accessible") == side, F.struct("rank", "name")))), lambda x: x["name"])
    count = lambda side: F.coalesce(F.sum(F.when(F.col("accessible") == side, F.col("n"))), F.lit(0))
    out = first.groupBy(by).agg(count(True).alias("accessible_hits"), count(False).alias("denied_hits"), names(True).alias("accessible_documents"), names(False).alias("denied_documents"))
    return out.withColumn("risk", risk(F.col("accessible_hits"), F.col("denied_hits")))

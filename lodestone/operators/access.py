"""Row-level access: an ordered policy cascade as one expression, scopes, and the organisation tree."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Subject:
    user: str
    organization: str = ""
    path: str = ""
    roles: Sequence[str] = ()
    groups: Sequence[str] = ()
    clearance: int = 0
    active: bool = True
    admin: bool = False


@dataclass
class Policy:
    """Names of the resource's columns; arrays where several values may be listed."""

    classification: str = "classification"
    visibility: str = "visibility"
    organization: str = "organization"
    path: str = "org_path"
    owner: str = "owner"
    denied_users: str = "denied_users"
    denied_roles: str = "denied_roles"
    allowed_users: str = "allowed_users"
    allowed_roles: str = "allowed_roles"
    sensitive_from: int = 3
    levels: dict = field(default_factory=dict)


def decision(subject: Subject, policy: Policy | None = None) -> Column:
    """STRUCT<allowed, reason>, the first rule that applies: inactive, denied user, denied role, administrator,
    clearance, allowed user, allowed role, sensitive without leave, owner, then visibility."""
    p = policy or Policy()
    has = lambda column, values: F.arrays_overlap(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(*map(F.lit, values)).cast("array<string>"))
    yes = lambda reason: F.struct(F.lit(True).alias("allowed"), F.lit(reason).alias("reason"))
    no = lambda reason: F.struct(F.lit(False).alias("allowed"), F.lit(reason).alias("reason"))
    level = F.coalesce(F.col(p.classification), F.lit(0))
    return (
        F.when(F.lit(not subject.active), no("inactive"))
        .when(has(p.denied_users, [subject.user]), no("denied_user"))
        .when(has(p.denied_roles, subject.roles), no("denied_role"))
        .when(F.lit(subject.admin), yes("admin"))
        .when(level > F.lit(subject.clearance), no("clearance"))
        .when(has(p.allowed_users, [subject.user]), yes("allowed_user"))
        .when(has(p.allowed_roles, subject.roles), yes("allowed_role"))
        .when(level >= F.lit(p.sensitive_from), no("sensitive"))
        .when(F.col(p.owner) == subject.user, yes("owner"))
        .when(F.col(p.visibility) == "public", yes("public"))
        .when((F.col(p.visibility) == "organization") & (F.col(p.organization) == subject.organization), yes("organization"))
        .when((F.col(p.visibility) == "subtree") & F.startswith(F.lit(subject.path), F.col(p.path)), yes("subtree"))
        .otherwise(no("no_rule"))
    )


@dataclass
class Reader:
    """A subject of the full cascade; ``scopes`` and ``actions`` below name what each rule applies to."""

    user: str
    organization: str = ""
    path: str = ""
    descendants: Sequence[str] = ()
    roles: Sequence[str] = ()
    groups: Sequence[str] = ()
    domains: Sequence[str] = ()
    projects: Sequence[str] = ()
    position: str = ""
    clearance: int = 1
    active: bool = True
    employed: bool = True


@dataclass
class Rules:
    """Settings of the cascade; classes are ranks."""

    open_to_all: bool = False
    super_admin: str = "SUPER_ADMIN"
    sensitive: Sequence[int] = (3, 4)
    manage_roles: Sequence[str] = ("ADMIN",)
    leadership_roles: Sequence[str] = ("LEADER",)
    leadership_positions: Sequence[str] = ()
    corporate_scopes: Sequence[str] = ("corp_public", "corp_internal")
    tree_scopes: Sequence[str] = ("unit_only", "subtree")


READING = ("search", "read_answer", "view_citation", "open_document", "download")
MANAGING = ("manage_acl", "delete", "ingest")


def cascade(who: Reader, action: str = "search", rules: Rules | None = None) -> Column:
    """STRUCT<allowed, policy> of a resource row, the first rule that applies.

    Columns: classification (rank), scope, owner_org_id, owner_org_path, uploaded_by, inherit_permission, business_domains,
    project_codes, and {denied, allowed}_{users, roles, groups, orgs, paths}. Null lists are empty, a null rank is 1 and a null
    inheritance is true.
    """
    r = rules or Rules()
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    listed = lambda column: F.coalesce(F.col(column), F.array().cast("array<string>"))
    among = lambda column, values: F.arrays_overlap(listed(column), texts([v for v in values if v]))
    below = lambda column: F.exists(listed(column), lambda p: F.lit(bool(who.path)) & ((p == who.path) | F.startswith(F.lit(who.path), F.concat(p, F.lit("/")))))
    organizations = [who.organization, *who.descendants]
    owner = F.coalesce(F.col("owner_org_path"), F.lit(""))
    same_path = (owner != "") & (owner == who.path)
    in_tree = F.coalesce(F.col("owner_org_id"), F.lit("")).isin(*[o for o in organizations if o]) | same_path | ((owner != "") & F.startswith(F.lit(who.path), F.concat(owner, F.lit("/"))))
    rank, scope = F.coalesce(F.col("classification"), F.lit(1)), F.coalesce(F.col("scope"), F.lit(""))
    verdict = lambda allowed, policy: F.struct((allowed if isinstance(allowed, Column) else F.lit(allowed)).alias("allowed"), (policy if isinstance(policy, Column) else F.lit(policy)).alias("policy"))
    out = F.when(F.lit(not (who.active and who.employed)), verdict(False, "subject"))
    out = out.when(F.lit(r.open_to_all and action in READING), verdict(True, "config"))
    for policy, hit in (("deny_user", among("denied_users", [who.user])), ("deny_role", among("denied_roles", who.roles)), ("deny_group", among("denied_groups", who.groups)), ("deny_org", among("denied_orgs", organizations) | below("denied_paths"))):
        out = out.when(hit, verdict(False, policy))
    out = out.when(F.lit(r.super_admin in who.roles), verdict(True, "role")).when(rank > who.clearance, verdict(False, "classification"))
    for policy, hit in (("allow_user", among("allowed_users", [who.user])), ("allow_role", among("allowed_roles", who.roles)), ("allow_group", among("allowed_groups", who.groups)), ("allow_org", among("allowed_orgs", organizations) | below("allowed_paths"))):
        out = out.when(hit, verdict(True, policy))
    out = out.when(rank.isin(*r.sensitive) & ~F.coalesce(F.col("inherit_permission"), F.lit(True)), verdict(False, "sensitive"))
    out = out.when(F.lit(bool(who.user)) & F.coalesce(F.col("uploaded_by") == who.user, F.lit(False)), verdict(True, "owner"))
    if action in MANAGING:
        manager = F.lit(bool(set(who.roles) & set(r.manage_roles)))
        return out.when(manager & in_tree, verdict(True, "role_org")).otherwise(verdict(False, "action"))
    leads = bool(set(who.roles) & set(r.leadership_roles)) or who.position in r.leadership_positions
    return (
        out.when(scope.isin(*r.corporate_scopes), verdict(True, scope))
        .when(scope.isin(*r.tree_scopes), verdict(in_tree, scope))
        .when(scope == "department_only", verdict(same_path, scope))
        .when(scope == "functional_vertical", verdict(among("business_domains", who.domains), scope))
        .when(scope == "project_only", verdict(among("project_codes", who.projects), scope))
        .when(scope == "leadership_only", verdict(leads, scope))
        .otherwise(verdict(False, scope))
    )


def normal_list(text: Column) -> Column:
    """A field of several values, separated by comma, semicolon or bar, as a sorted set."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")))


def pass_context(rows: DataFrame, who: Reader, access: str = "has_access") -> DataFrame:
    """Context rows that the reader may see; rows without access metadata pass."""
    return rows.filter(~F.coalesce(F.col(access), F.lit(False)) | cascade(who, "read_answer")["allowed"])


def visible(rows: DataFrame, subject: Subject, policy: Policy | None = None) -> DataFrame:
    return rows.filter(decision(subject, policy)["allowed"])


def inherit(own: Column, parent: Column) -> Column:
    """A chunk's access value where it is not empty, else its document's."""
    return F.when(own.isNotNull() & (F.size(own) > 0), own).otherwise(parent)


def descendants(nodes: DataFrame, root: str, code: str = "code", parent: str = "parent_code") -> DataFrame:
    """(code, depth) of the root and all below it, each once at its least depth; cycles end, and no depth is too deep.

    One join a level, until a level is empty; each level is checkpointed where ``spark.checkpoint.dir`` says, so lineage stays short.
    """
    spark = nodes.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = where or tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(where)
    edges = nodes.select(F.col(code).alias("code"), F.col(parent).alias("parent")).checkpoint()
    found = level = edges.filter(F.col("code") == root).select("code", F.lit(0).cast("long").alias("depth")).distinct().checkpoint()
    depth = 0
    while not level.isEmpty():
        depth += 1
        below = edges.join(level.select(F.col("code").alias("parent")), "parent").select("code").distinct()
        level = below.join(found.select("code"), "code", "left_anti").select("code", F.lit(depth).cast("long").alias("depth")).checkpoint()
        found = found.unionByName(level)
        if depth % 16 == 0:  # a union of many levels becomes one table
            found = found.checkpoint()
    return found


def granted(subjects: DataFrame, grants: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(subject columns, resource, how): grants that name a subject by any of several keys.

    ``grants`` has kind, value and resource; ``keys`` maps a kind to the subject's column. An either-or join is a
    union of one equality join a kind, so each can be hashed or broadcast.
    """
    parts = None
    for kind, column in keys.items():
        mine = grants.filter(F.col("kind") == kind).select(F.col("value").alias("_value"), "resource")
        part = subjects.join(mine, F.col(column).cast("string") == F.col("_value")).drop("_value").withColumn("how", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    return parts

"""Scope and delivery rules as Columns over scope_type, scope_id, visibility, egress_policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
GLOBAL_ID = "global:doctrine"
CONFIDENTIAL = ("confidential", "secret")
PRIVACY_RANK = {"private": 0, "workspace": 1, "project": 2, "public": 3}
TARGETS = ("local_model", "hosted_model", "hosted_teacher", "human_export")


@dataclass(frozen=True)
class ScopeContext:
    project: str | None = None
    repo: str | None = None
    client: str | None = None
    task: str | None = None
    session: str | None = None
    runtime: str | None = None

    def compatible_ids(self) -> list[str]:
        named = (("project", self.project), ("repo", self.repo), ("client", self.client), ("task", self.task), ("session", self.session))
        return [GLOBAL_ID, *(f"{k}:{v}" for k, v in named if v)]

    def write_scope(self) -> dict[str, str]:
        """The scope that a write in this context gets: the narrowest part named, quarantine without any."""
        closed = {"visibility": "confidential", "egress_policy": "local_only", "provenance": "inferred"}
        open_ = {"visibility": "internal", "egress_policy": "approval_required", "provenance": "inferred"}
        for kind in ("task", "session", "repo", "client", "project"):
            value = getattr(self, kind)
            if value:
                return {"scope_type": kind, "scope_id": f"{kind}:{value}"} | (closed if self.client is not None else open_)
        return {"scope_type": "legacy_unscoped", "scope_id": "legacy:unscoped", "visibility": "internal", "egress_policy": "local_only", "provenance": "quarantined"}


def is_confidential() -> Column:
    return F.col("visibility").isin(*CONFIDENTIAL) | (F.col("scope_type") == "client")


def hosted_ok() -> Column:
    return (F.col("egress_policy") == "hosted_ok") & ~is_confidential()


def scope_weight(context: ScopeContext, cross_scope: bool = False) -> Column:
    """1 global; 0.05 unscoped and 0.15 others across scopes; 1.25 in the context; 0 else. In this order."""
    return (
        F.when(F.col("scope_type") == "global", 1.0)
        .when(F.col("scope_type") == "legacy_unscoped", 0.05 if cross_scope else 0.0)
        .when(F.col("scope_id").isin(*context.compatible_ids()), 1.25)
        .when(is_confidential(), 0.0)
        .otherwise(0.15 if cross_scope else 0.0)
    )


def egress(context: ScopeContext, target: str, cross_scope: bool = False) -> Column:
    """struct(allowed, reason). A prohibited row for a local model is (false, allowed_local)."""
    policy, visibility = F.col("egress_policy"), F.col("visibility")
    pair = lambda ok, why: F.struct(ok.alias("allowed"), why.alias("reason"))
    no = F.lit(False)
    if target == "local_model":
        decided = pair(policy != "prohibited", F.lit("allowed_local"))
    elif target in ("hosted_model", "hosted_teacher"):
        denied = F.concat(F.lit("egress_policy:"), policy, F.lit(";visibility:"), visibility)
        decided = pair(hosted_ok(), F.when(hosted_ok(), "allowed_hosted").otherwise(denied))
    elif target == "human_export":
        fine = policy.isin("hosted_ok", "approval_required")
        decided = pair(fine, F.when(fine, "allowed_export").otherwise(F.concat(F.lit("egress_policy:"), policy)))
    else:
        decided = pair(no, F.lit(f"unknown_target:{target}"))
    return F.when(scope_weight(context, cross_scope) == 0, pair(no, F.lit("scope_mismatch"))).otherwise(decided)


def scope_gate(context: ScopeContext, cross_scope: bool = False) -> Column:
    """The filter before ranking, in terms that are pushed down to the scan."""
    own = (F.col("scope_type") == "global") | F.col("scope_id").isin(*context.compatible_ids())
    if not cross_scope:
        return own
    return own | (~F.col("scope_type").isin("legacy_unscoped", "client") & ~F.col("visibility").isin(*CONFIDENTIAL))


def delivery_gate(target: str) -> Column:
    if target == "hosted_model":
        return (F.col("egress_policy") == "hosted_ok") & (F.col("scope_type") != "client") & ~F.col("visibility").isin(*CONFIDENTIAL)
    if target == "local_model":
        return F.col("egress_policy") != "prohibited"
    raise ValueError(f"unsupported delivery target: {target}")


def privacy_rank(scope: Column) -> Column:
    ranked = F.lit(PRIVACY_RANK["workspace"])
    for name, rank in PRIVACY_RANK.items():
        ranked = F.when(scope == name, rank).otherwise(ranked)
    return ranked


def privacy_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PRIVACY_RANK)), (rank + 1).cast("int"))


def most_restrictive(scope: Column) -> Column:
    """Aggregate: the privacy scope with the least rank; workspace where there is none."""
    return F.coalesce(privacy_name(F.min(privacy_rank(scope))), F.lit("workspace"))


def privacy_of_scope() -> Column:
    """Scope tag to privacy scope: private unless it may be hosted."""
    return F.when(hosted_ok(), "workspace").otherwise("private")


def conservative_scope(project: Column, path: Column) -> Column:
    """Scope of an old row: its explicit project, else its path under a hash, else quarantine."""
    hashed = F.concat(F.lit("project:path-"), F.substring(F.sha2(F.encode(path, "UTF-8"), 256), 1, 16))
    some = lambda c: c.isNotNull() & (F.trim(c) != "")
    kind = F.when(some(project) | some(path), "project").otherwise("legacy_unscoped")
    ident = F.when(some(project), F.concat(F.lit("project:"), F.trim(project))).when(some(path), hashed).otherwise("legacy:unscoped")
    return F.struct(kind.alias("scope_type"), ident.alias("scope_id"), F.lit("internal").alias("visibility"), F.lit("local_only").alias("egress_policy"))

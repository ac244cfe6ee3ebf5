"""Allowed values of the data model, and a check for them.

All times are epoch milliseconds (BIGINT); ids are 16 hex digits of a SHA-1.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
ROLES = ("user", "assistant", "tool", "system")
AGENTS = ("cursor", "claude-code", "codex", "copilot", "docs")
CORE_KINDS = ("decision", "business_rule", "entity", "constraint", "requirement", "actor", "process", "metric")
ANCHORED_KINDS = ("intent", "problem", "solution", "pattern")
DEDUPE_KINDS = ("entity", "business_rule", "requirement", "feature", "constraint", "actor", "process", "metric", "glossary_term", "decision")
EVIDENCE_KINDS = (
    "path_mention", "code_block", "shell_command", "error_message", "stack_trace", "ticket_id", "url", "dependency", "tool",
    "knowledge_gap", "business_domain", "tech_domain", "incident", "root_cause",
)
GRAPH_KINDS = (
    "business_domain", "tech_domain", "entity", "requirement", "feature", "incident", "root_cause", "business_rule", "skill",
    "actor", "process", "metric", "glossary_term", "knowledge_gap",
)
GRAPH_EDGE_KINDS = ("part_of", "relates_to", "owned_by", "governed_by", "has_state", "transitions_to", "depends_on")
AREAS = {
    "language": "Languages", "framework": "Frameworks", "library": "Libraries", "tool": "Tooling & Infrastructure",
    "infra": "Tooling & Infrastructure", "dependency": "Libraries", "skill": "Engineering Practices", "domain": "Domain Knowledge",
}
OTHER_AREA = "Engineering Practices"
GENERIC_FOLDERS = (
    "workspace", "workspaces", "projects", "project", "repos", "repositories", "code", "src", "dev", "work", "documents",
    "desktop", "git", "github", "sites",
)
SCOPES = ("industry", "technical", "meta")
GROUNDINGS = ("structural", "corroborated", "stated", "external", "model")
LEVELS = ("novice", "advanced_beginner", "competent", "proficient", "expert")
#: Which grounding is the stronger one in a concept, and among duplicates: two different orders.
CONCEPT_RANK = {"structural": 5, "corroborated": 4, "stated": 3, "external": 2, "model": 1}
SURVIVOR_RANK = {"corroborated": 4, "structural": 3, "stated": 2, "external": 1, "model": 0}


def rank(col: Column, order: dict[str, int], missing: str = "stated") -> Column:
    """The rank of a grounding; null counts as ``missing``, an unknown one as 0."""
    m = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return F.coalesce(m[F.coalesce(col, F.lit(missing))], F.lit(0))


def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """The rows whose value is written but not allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))

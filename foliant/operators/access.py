"""Who may read what: principals with inherited roles, entries on documents, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.graph import reachable

EVERYONE = "everyone"


def effective_principals(members: DataFrame, inherits: DataFrame) -> DataFrame:
    """(user, principal): everything a user counts as: itself, its roles (members: user, role) and the roles these inherit (inherits: role, parent), and
    everyone. Inheritance in a circle does no harm, and chains are followed to their end."""
    roles = members.select(F.col("role").alias("seed")).filter("seed is not null").distinct()
    closure = reachable(inherits.select(F.col("role").alias("src"), F.col("parent").alias("dst")).filter("src is not null and dst is not null"), roles, None)
    inherited = members.join(closure, members["role"] == closure["seed"]).select("user", F.col("node").alias("principal"))
    users = members.select("user").filter("user is not null").distinct()
    own = users.select("user", F.explode(F.array(F.col("user"), F.lit(EVERYONE))).alias("principal"))
    return inherited.filter("user is not null").union(own).distinct()


def readable(documents: DataFrame, entries: DataFrame, principals: DataFrame, open_by_default: bool = False) -> DataFrame:
    """(user, doc): the documents (doc, owner) each user of principals (user, principal) owns or has an entry for (entries: doc, principal); with
    open_by_default also those without any entry."""
    owned = documents.join(principals.select("user").distinct(), documents["owner"] == F.col("user")).select("user", "doc")
    granted = entries.select("doc", "principal")
    if open_by_default:
        free = documents.select("doc").join(entries.select("doc"), "doc", "left_anti")
        granted = granted.union(free.select("doc", F.lit(EVERYONE)))
    return owned.union(granted.distinct().join(principals, "principal").select("user", "doc")).distinct()


def readable_counts(documents: DataFrame, entries: DataFrame, principals: DataFrame) -> DataFrame:
    """(user, n_documents): how many documents readable() gives each user, without pairing users with what everyone may read: those documents are counted
    once, and a user's other ones that are not among them are added."""
    public = entries.filter(F.col("principal") == EVERYONE).select("doc").distinct().join(documents.select("doc"), "doc", "left_semi")
    owned = documents.filter("owner is not null").select(F.col("owner").alias("user"), "doc")
    own = entries.filter(F.col("principal") != EVERYONE).select("doc", "principal").distinct().join(principals, "principal").select("user", "doc")
    users = principals.select("user").distinct()
    extra = owned.join(users, "user", "left_semi").union(own).distinct().join(public, "doc", "left_anti").groupBy("user").agg(F.count("*").alias("n"))
    all_ = public.agg(F.count("*").alias("n_public"))
    return users.join(extra, "user", "left").crossJoin(F.broadcast(all_)).select("user", (F.coalesce("n", F.lit(0)) + F.col("n_public")).alias("n_documents")).filter("n_documents > 0")  # a single row

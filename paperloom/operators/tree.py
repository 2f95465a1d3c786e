"""Criteria trees: typification, taxonomy, branch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten(roots: DataFrame, mids: DataFrame, leaves: DataFrame, mid_key: str, leaf_key: str, root_id: str = "id", mid_id: str = "id"):
    """One row for each leaf with its mid and root; inner joins, so deleted nodes, filtered from their tables, hide all
    below. Columns are prefixed root_, mid_ and leaf_."""
    r = roots.select(*[F.col(c).alias(f"root_{c}") for c in roots.columns])
    m = mids.select(*[F.col(c).alias(f"mid_{c}") for c in mids.columns])
    leaf = leaves.select(*[F.col(c).alias(f"leaf_{c}") for c in leaves.columns])
    return r.join(m, F.col(f"root_{root_id}") == F.col(f"mid_{mid_key}")).join(
        leaf, F.col(f"mid_{mid_id}") == F.col(f"leaf_{leaf_key}")
    )


def nest_via(parents: DataFrame, bridge: DataFrame, children: DataFrame, parent_id: str, parent_key: str, child_key: str, order: str, alias: str, child_id: str = "id"):
    """Parents with the array ``alias`` of the children that a bridge table links them with."""
    links = bridge.select(F.col(parent_key).alias("__bp"), F.col(child_key).alias("__bc")).distinct()
    own = links.join(children, F.col("__bc") == F.col(child_id)).drop("__bc")
    return nest(parents, own, parent_id, "__bp", order, alias)


def by_release(releases: DataFrame, histories: DataFrame, documents: DataFrame, links: DataFrame, typifications: DataFrame) -> DataFrame:
    """(release_id, id, name): the typifications of each release's document, through its history; deleted ones are out of
    their tables."""
    r = releases.select(F.col("id").alias("release_id"), F.col("history_id").alias("__h"))
    h = histories.select(F.col("id").alias("__h"), F.col("document_id").alias("__d"))
    d = documents.select(F.col("id").alias("__d"))
    link = links.select(F.col("document_id").alias("__d"), F.col("typification_id").alias("id"))
    out = r.join(h, "__h").join(d, "__d").join(link, "__d").join(typifications.select("id", "name"), "id")
    return out.select("release_id", "id", "name").distinct()


def release_details(releases: DataFrame, histories: DataFrame, documents: DataFrame, editors: DataFrame, users: DataFrame) -> DataFrame:
    """Releases with their history, its document and that document's editors as nested structs; a missing hop is null."""
    docs = nest_via(documents.select("id", "name"), editors, users.select("id", "username"), "id", "document_id", "user_id", "username", "editors")
    h = histories.select(F.col("id").alias("__h"), "status", F.col("document_id").alias("__d"))
    d = docs.select(F.col("id").alias("__d"), F.struct("id", "name", "editors").alias("document"))
    h = h.join(d, "__d", "left").select("__h", F.struct(F.col("__h").alias("id"), "status", "document").alias("history"))
    return releases.join(h, releases["history_id"] == F.col("__h"), "left").drop("__h")


def full_branches(branches: DataFrame, taxonomies: DataFrame, typifications: DataFrame, taxonomy_sources: DataFrame, typification_sources: DataFrame, sources: DataFrame):
    """Branches with their taxonomy and typification, each with its sources, as nested structs."""
    s = sources.select("id", "name")
    typ = nest_via(typifications.select("id", "name"), typification_sources, s, "id", "typification_id", "source_id", "name", "sources")
    tax = nest_via(taxonomies.select("id", "title", "typification_id"), taxonomy_sources, s, "id", "taxonomy_id", "source_id", "name", "sources")
    typ = typ.select(F.col("id").alias("__t"), F.struct("id", "name", "sources").alias("typification"))
    tax = tax.join(typ, F.col("typification_id") == F.col("__t"), "left")
    tax = tax.select(F.col("id").alias("__x"), F.struct("id", "title", "sources", "typification").alias("taxonomy"))
    return branches.join(tax, branches["taxonomy_id"] == F.col("__x"), "left").drop("__x")


def with_roles(links: DataFrame, people: DataFrame, roles: Sequence[str], name: str = "username") -> DataFrame:
    """Links with the name of the person in each role (columns ``<role>_id``): one dimension, joined once for each role."""
    for role in roles:
        own = people.select(F.col("id").alias(f"__{role}"), F.col(name).alias(role))
        links = links.join(own, F.col(f"{role}_id") == F.col(f"__{role}"), "left").drop(f"__{role}")
    return links


def with_quoted(messages: DataFrame, key: Sequence[str], quoted: Sequence[str], /, **columns: str) -> DataFrame:
    """Messages with columns (new name = column) of the message that each quotes, whose key stands in ``quoted``: the table
    joined to itself, so a message that quotes none, or one that is gone, has nulls. Keys are unique."""
    names = [f"__{i}" for i in range(len(key))]
    own = messages.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], *[F.col(c).alias(n) for n, c in columns.items()])
    same = [F.col(q) == F.col(n) for q, n in zip(quoted, names, strict=True)]
    return messages.join(own, same, "left").drop(*names)


def nest(parents: DataFrame, children: DataFrame, parent_id: str, child_key: str, order: str, alias: str, descending: bool = False) -> DataFrame:
    """Parents with the array ``alias`` of their children, sorted by ``order``; parents without any have an empty array."""
    item = F.struct(F.col(order).alias("__o"), F.struct(*[c for c in children.columns if c != child_key]).alias("v"))
    own = children.groupBy(F.col(child_key).alias("__p")).agg(F.sort_array(F.collect_list(item), asc=not descending).alias("__c"))
    out = parents.join(own, F.col(parent_id) == F.col("__p"), "left")
    kind = own.select(F.transform("__c", lambda x: x["v"]).alias("x")).schema["x"].dataType
    values = F.coalesce(F.transform("__c", lambda x: x["v"]), F.array().cast(kind))
    return out.withColumn(alias, values).drop("__p", "__c")


def report_lines(nested: DataFrame, root_name: str = "name", mids: str = "taxonomies", leaves: str = "branches") -> DataFrame:
    """(root, j, k, line): a nested tree as report lines in display order, headings before what they hold."""
    base = nested.select(F.col(root_name).alias("root"), F.posexplode_outer(mids).alias("j", "m"))
    roots = nested.select(F.col(root_name).alias("root"), F.lit(-1).alias("j"), F.lit(-1).alias("k"), F.col(root_name).alias("line"))
    mid = base.where("m is not null").select("root", "j", F.lit(-1).alias("k"), F.concat(F.lit("  "), "m.title").alias("line"))
    leaf = base.select("root", "j", F.posexplode(f"m.{leaves}").alias("k", "b"))
    leaf = leaf.select("root", "j", "k", F.concat(F.lit("    "), "b.title").alias("line"))
    return roots.unionByName(mid).unionByName(leaf)


def tri_state(fulfilled: Column) -> Column:
    """How a report shows a verdict."""
    return F.when(fulfilled.isNull(), F.lit("Indefinido")).when(fulfilled, F.lit("Cumprido")).otherwise(F.lit("Não cumprido"))


def references(tree: DataFrame, path: str = "references") -> DataFrame:
    """(id, chunk_id, page, x, y, width, height) of every rectangle of every reference."""
    refs = tree.select("id", F.explode(path).alias("r"))
    rects = refs.select("id", F.col("r.chunk_id").alias("chunk_id"), F.col("r.page").alias("page"), F.explode("r.rects").alias("q"))
    return rects.select(
        "id", "chunk_id", "page", F.col("q.x1").alias("x"), F.col("q.y1").alias("y"),
        (F.col("q.x2") - F.col("q.x1")).alias("width"), (F.col("q.y2") - F.col("q.y1")).alias("height"),
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], alias: str) -> DataFrame:
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def snapshot(tree: DataFrame, release: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applied typifications, taxonomies and branches of one release from a flat tree; ids are hashes of release and
    original, so doing it again gives the same rows."""
    made = lambda kind, original: F.sha2(F.concat_ws("|", F.lit(release), F.lit(kind), original), 256)
    typ = tree.select("root_id", "root_name").distinct()
    typ = typ.select(
        made("typification", F.col("root_id")).alias("id"), F.col("root_id").alias("original_id"),
        F.lit(release).alias("applied_release_id"), F.col("root_name").alias("name"),
    )
    tax = tree.select("root_id", "mid_id", "mid_title", "mid_description").distinct()
    tax = tax.select(
        made("taxonomy", F.col("mid_id")).alias("id"), F.col("mid_id").alias("original_id"),
        made("typification", F.col("root_id")).alias("applied_typification_id"), F.col("mid_title").alias("title"),
        F.col("mid_description").alias("description"),
    )
    branch = tree.select(
        made("branch", F.col("leaf_id")).alias("id"), F.col("leaf_id").alias("original_id"),
        made("taxonomy", F.col("mid_id")).alias("applied_taxonomy_id"), F.col("leaf_title").alias("title"),
    )
    return typ, tax, branch.distinct()

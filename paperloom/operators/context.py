"""Context assembly, payloads, mentions and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a context, a query and a status are written.
SEPARATOR = "\n\n---\n\n"
SECTION_HEAD = "## CONTEXTO DA SESSÃO: %s\n"
CHUNK_HEAD = "[FONTE] chunk_id: %s\n"
UNKNOWN_CHUNK = "unknown_id"
QUERY = "\nSECTION: %1$s\nSECTION: %1$s\nSECTION: %1$s\n--- %2$s\n"
STATUSES = {
    "PENDING": "Pendente", "UNDER_CONSTRUCTION": "Em construção", "WAITING_FOR_REVIEW": "Aguardando revisão",
    "COMPLETED": "Concluído",
}


def context(chunks: DataFrame, keys: list[str], order: str = "chunk_index") -> DataFrame:
    """(keys, context): each group's chunks in order, each under its chunk_id; where the section changes, a separator (but
    at the start) and the new section's head (if it has a title). A chunk's own section header is left out."""
    titled = chunks.withColumn("__s", F.coalesce(F.trim("section_title"), F.lit("")))
    w = Window.partitionBy(*keys).orderBy(order, "chunk_id")
    first = F.row_number().over(w) == 1
    moved = ~F.col("__s").eqNullSafe(F.coalesce(F.lag("__s").over(w), F.lit("")))
    lines = titled.withColumn("__first", first).withColumn("__moved", moved | first)
    head = F.concat(
        F.when(F.col("__moved") & ~F.col("__first"), SEPARATOR).otherwise(""),
        F.when(F.col("__moved") & (F.col("__s") != ""), F.format_string(SECTION_HEAD, "__s")).otherwise(""),
        F.format_string(CHUNK_HEAD, F.coalesce(F.col("chunk_id").cast("string"), F.lit(UNKNOWN_CHUNK))),
    )
    lines = lines.withColumn("__line", F.concat(head, strip_header(F.coalesce("text", F.lit("")), F.col("__s"))))
    items = F.array_sort(F.collect_list(F.struct(order, "chunk_id", "__line")))
    return lines.groupBy(*keys).agg(_stripped(F.array_join(F.transform(items, lambda x: x["__line"]), "")).alias("context"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_header(text: Column, title: Column) -> Column:
    """The text after its section header, if it begins with it."""
    head = F.concat(F.lit("SECTION: "), title, F.lit("\n\n"))
    return F.when(text.startswith(head), F.substring(text, F.char_length(head) + 1, F.char_length(text))).otherwise(text)


def query_text(section: Column, query: Column) -> Column:
    """What is searched for: the section three times, then the query."""
    return F.format_string(QUERY, section, query)


def requirement(title: Column, description: Column) -> Column:
    """``title: description`` if both are there, else whichever is."""
    t, d = F.nullif(title, F.lit("")), F.nullif(description, F.lit(""))
    return F.when(t.isNotNull() & d.isNotNull(), F.concat(t, F.lit(": "), d)).otherwise(F.coalesce(t, d))


# What tags and a mention of the model look like.
TAG = r"<([^:]+):([^>]+)>"
MODEL_TAG = r"<ai:[^>]+>"


def tags(text: Column) -> Column:
    """Tags ``<type:id>`` as structs."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(TAG), 1), F.regexp_extract_all(text, F.lit(TAG), 2))
    return F.transform(both, lambda x: F.struct(x["0"].alias("type"), x["1"].alias("id")))


def mentions_model(text: Column) -> Column:
    return F.coalesce(text.rlike(MODEL_TAG), F.lit(False))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def payloads(branches: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """Branches with their context; those without one, or with a blank one, go."""
    return branches.join(contexts, key).where(F.trim("context") != "")


def flatten_args(nested: DataFrame) -> DataFrame:
    """Branch sessions of nested typifications; null and empty levels bring nothing."""
    t = nested.select(F.explode("typifications").alias("t"))
    x = t.select(F.col("t.name").alias("typification"), F.explode("t.taxonomies").alias("x"))
    b = x.select("typification", F.col("x.title").alias("taxonomy"), F.explode("x.branches").alias("b"))
    return b.select("typification", "taxonomy", F.col("b.id").alias("branch_id"), F.explode("b.sessions").alias("session"))


def merge_maps(df: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """One map a key: entries of all rows, the last write of each entry wins."""
    entries = df.select(key, order, F.explode(column).alias("__k", "__v"))
    last = entries.groupBy(key, "__k").agg(F.max_by("__v", order).alias("__v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(column))


def academic_context(documents: DataFrame, advisorships: DataFrame, project_documents: DataFrame, users: DataFrame) -> DataFrame:
    """Each document with author, advisors (distinct names in order of advisorship) and project: the advisorship's, else
    its project document's."""
    own = advisorships.select(F.col("id").alias("advisorship_id"), F.col("project_id").alias("__ap"), "advisee_id")
    pd = project_documents.select(F.col("id").alias("project_document_id"), F.col("project_id").alias("__pp"))
    out = documents.join(own, "advisorship_id", "left").join(pd, "project_document_id", "left")
    out = out.withColumn("project_id", F.coalesce("__ap", "__pp")).drop("__ap", "__pp")
    author = users.select(F.col("id").alias("created_by"), F.col("username").alias("author"))
    out = out.join(author, "created_by", "left")
    links = advisorships.select("advisee_id", "advisor_id", "created_at", F.col("id").alias("__l"))
    named = links.join(users.select(F.col("id").alias("advisor_id"), F.col("username").alias("advisor")), "advisor_id")
    items = F.array_sort(F.collect_list(F.struct("created_at", "__l", "advisor")))
    advisors = named.groupBy("advisee_id").agg(F.array_distinct(F.transform(items, lambda x: x["advisor"])).alias("advisors"))
    return out.join(advisors, "advisee_id", "left")


def fanout(df: DataFrame, *columns: str) -> DataFrame:
    """(user_id): the distinct ids in the columns; nulls go."""
    return df.select(F.explode(F.array_compact(F.array(*columns))).alias("user_id")).distinct()


# The roles that are told of a new status; auditors are told of every document.
TOLD = [("UNDER_CONSTRUCTION", "editor"), ("WAITING_FOR_REVIEW", "creator"), ("WAITING_FOR_REVIEW", "auditor"), ("COMPLETED", "editor")]


AUDIT_SALTS = 64
TASK_ROWS = 1_000_000  # rows of a task, about, however many there are


def notifications(changes: DataFrame, parties: DataFrame, auditors: DataFrame) -> DataFrame:
    """(document_id, status, user_id) to tell, each once: changes (document_id, status) by the rules of TOLD to the
    document's parties (document_id, role: editor or creator, user_id) and to all ``auditors`` (user_id). A status without
    a rule tells nobody.

    Counts set how many tasks there are, since ids shrink so much in a shuffle that its bytes don't tell its rows."""
    spark = changes.sparkSession
    least, n_changes = int(spark.conf.get("spark.sql.shuffle.partitions")), changes.count()
    auditors = auditors.select("user_id").distinct()
    tasks = max(least, 1 + (2 * n_changes + parties.count()) // TASK_ROWS)
    told = max(least, 1 + n_changes * (1 + auditors.count()) // TASK_ROWS)
    rules = spark.createDataFrame(TOLD, "status string, role string")
    due = changes.join(F.broadcast(rules), "status")
    at = ["document_id", "role"]
    own = due.repartition(tasks, *at).join(parties.repartition(tasks, *at), at).select("document_id", "status", "user_id")
    # every document meets every auditor: documents are dealt over salts, and auditors, who are few, come to each
    salts = max(AUDIT_SALTS, tasks)
    all_ = due.where("role = 'auditor'").select("document_id", "status")
    all_ = all_.withColumn("__salt", F.pmod(F.xxhash64("document_id", "status"), F.lit(salts))).repartition(salts, "__salt")
    held = auditors.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    every = all_.join(held, "__salt").select("document_id", "status", "user_id")
    out = own.unionByName(every).where("user_id is not null")
    return out.repartition(told, "document_id", "status", "user_id").distinct()


def translated(status: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, status), status)

"""Audit records: what a change did, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.context import STATUSES

MAP = "map<string,string>"
ITEMS = "array<struct<id:string,name:string,title:string>>"

# The words of an audit record.
IGNORED = ["_sa_instance_state", "updated_at"]
CREATED, DELETED, ALTERED, UNCHANGED = "Registro criado.", "Registro removido.", "Registro alterado.", "Salvo sem alterações."
FIELDS = {"is_active": "Ativo", "created_at": "Data de Criação", "name": "Nome", "description": "Descrição", "status": "Status"}
EMPTY, YES, NO, CONFIGURED, NO_STATUS = "Vazio", "Sim", "Não", "Configurado", "Sem status"
MOVED = "Moveu o documento da etapa '%s' para '%s'"
ADDED, REMOVED = "Adicionou '%s' em %s", "Removeu '%s' de %s"
MODIFIED, CHANGED = "%s modificado", "Alterou %s de '%s' para '%s'"


def _named(names: dict[str, str], key: Column, other: Column) -> Column:
    held = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(held, key), other)


def field_name(key: Column) -> Column:
    """A field as it is shown: a fixed word, else its key with blanks, capitalised."""
    words = F.lower(F.replace(key, F.lit("_"), F.lit(" ")))
    return _named(FIELDS, key, F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 2**31 - 1)))


def _kind(value: Column) -> Column:
    """What a JSON value is: NULL, BOOLEAN, LIST, OBJECT or OTHER."""
    t = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (t == "VOID"), "NULL").when(t == "BOOLEAN", "BOOLEAN").when(t.startswith("ARRAY"), "LIST")
        .when(t.startswith("OBJECT"), "OBJECT").otherwise("OTHER")
    )


def shown(value: Column) -> Column:
    """A JSON value for reading."""
    kind, text = _kind(value), F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "NULL", EMPTY).when(kind == "BOOLEAN", F.when(text == "true", YES).otherwise(NO))
        .when(kind.isin("LIST", "OBJECT"), CONFIGURED).otherwise(text)
    )


def _members(value: Column) -> Column:
    """The objects with an id of a list, and how each is called."""
    items = F.filter(F.coalesce(F.from_json(F.to_json(value), ITEMS), F.array().cast(ITEMS)), lambda i: F.coalesce(i["id"], F.lit("")) != "")
    return F.transform(items, lambda i: F.struct(i["id"].alias("id"), F.coalesce(i["name"], i["title"], i["id"]).alias("name")))


def _gone(a: Column, b: Column) -> Column:
    """Members of ``a`` that ``b`` lacks, by id."""
    ids = F.transform(b, lambda i: i["id"])
    return F.array_sort(F.filter(a, lambda i: ~F.array_contains(ids, i["id"])))


def _status(value: Column) -> Column:
    """The status of a history's first item, as it is shown."""
    raw = F.try_variant_get(value, "$[0].status", "string")
    return _named(STATUSES, raw, F.coalesce(F.nullif(raw, F.lit("")), F.lit(NO_STATUS)))


def audit_diff(records: DataFrame) -> DataFrame:
    """(id, description) of audit records (id, action, old_data, new_data; JSON objects).

    CREATE and DELETE have fixed words, and so has a change of which either side is missing or empty. Otherwise each key of
    the new record that is not ignored is looked at, in the record's order: a list called history tells of its first item's
    status, other lists gain and lose members (by id, shown by name, title or id, in order of id), other values change.
    Keys that only the old record has don't count. Two maps are compared key by key within the row; nothing is shuffled."""
    df = records.select("id", "action", *[F.from_json(f"{s}_data", MAP).alias(f"__k{s}") for s in ("old", "new")],
                        *[F.try_parse_json(f"{s}_data").try_cast("map<string,variant>").alias(f"__{s}") for s in ("old", "new")])

    def phrases(key: Column) -> Column:
        a, b = F.try_element_at(F.col("__old"), key), F.try_element_at(F.col("__new"), key)
        name, lists = field_name(key), (_kind(a) == "LIST") & (_kind(b) == "LIST")
        none = F.array().cast("array<string>")
        x, y = _members(a), _members(b)
        plus = F.transform(_gone(y, x), lambda i: F.format_string(ADDED, i["name"], name))
        minus = F.transform(_gone(x, y), lambda i: F.format_string(REMOVED, i["name"], name))
        raw = [F.coalesce(F.try_variant_get(v, "$[0].status", "string"), F.lit("")) for v in (a, b)]
        moved = F.when(raw[0] != raw[1], F.array(F.format_string(MOVED, _status(a), _status(b)))).otherwise(none)
        both = (shown(a) == CONFIGURED) & (shown(b) == CONFIGURED)
        plain = F.when(both, F.format_string(MODIFIED, name)).otherwise(F.format_string(CHANGED, name, shown(a), shown(b)))
        same = F.to_json(a).eqNullSafe(F.to_json(b)) | ((_kind(a) == "NULL") & (_kind(b) == "NULL"))
        return (
            F.when(lists & (key == "history"), moved).when(lists, F.concat(plus, minus)).when(same, none).otherwise(F.array(plain))
        )

    keys = F.array_except(F.map_keys("__knew"), F.array(*[F.lit(k) for k in IGNORED]))
    said = F.flatten(F.transform(keys, phrases))
    empty = lambda c: F.coalesce(F.size(F.map_keys(c)), F.lit(0)) == 0
    text = (
        F.when(F.col("action") == "CREATE", CREATED).when(F.col("action") == "DELETE", DELETED)
        .when(empty(F.col("__kold")) | empty(F.col("__knew")), ALTERED)
        .when(F.size(said) == 0, UNCHANGED).otherwise(F.array_join(said, "; "))
    )
    return df.select("id", text.alias("description"))


def audit_rows(records: DataFrame, table: str, at: Column) -> DataFrame:
    """Rows of ``audit_logs`` for audit records (id, action, user_id, record_id, old_data, new_data)."""
    told = records.join(audit_diff(records), "id")
    return told.select(
        F.col("id").cast("string").alias("id"), F.lit(table).alias("table_name"), F.col("record_id").cast("string").alias("record_id"),
        "action", F.col("user_id").cast("string").alias("user_id"), "old_data", at.alias("created_at"), "description",
    )


def list_changes(before: Column, after: Column) -> tuple[Column, Column]:
    """(added, removed): distinct elements of one list that the other lacks, sorted; a missing list is an empty one."""
    gone = lambda x, y: F.array_sort(F.array_except(x, y))
    none = F.array()
    own, new = F.coalesce(before, none), F.coalesce(after, none)
    return gone(new, own), gone(own, new)

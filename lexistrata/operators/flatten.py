"""Catalog records into flat metadata rows and distribution rows.

Records are structs, whose members are plain columns that the scan is pruned to, or VARIANT values, whose optional, missing
and oddly typed members need no schema. Everything is one projection of built-in expressions; distributions come from one
``posexplode``. Member access falls back the way loosely typed records need: an empty text, zero, false, empty list or
empty object counts as nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistrata.operators.nested import is_object, member
from lexistrata.operators.values import Value, compact_sql, either, first_list, fresh, literal, of

LIST_LIMIT = 50


def as_record(df: DataFrame, *columns: str) -> Column:
    """The columns of a table as one record; null members are left out of it."""
    return F.try_parse_json(F.to_json(F.struct(*(columns or df.columns))))


def as_text(value: Column) -> Column:
    """A VARIANT as text: strings as they are, null as the empty string, anything else as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def has(value: Column, name: str) -> Column:
    """Whether a VARIANT object has a member, be it null."""
    return member(value, name).isNotNull()


def list_items(value: Column) -> Column:
    """The items of a VARIANT list, none for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def first_text(record: Column, *names: str) -> Column:
    """The first member of a VARIANT that counts as something, as text."""
    found = []
    for name in names:
        value = member(record, name)
        text = F.try_variant_get(value, "$", "string")
        nothing = text.isin("", "0", "0.0", "false", "[]", "{}") & ~(F.to_json(value).startswith('"') & (text != ""))
        found.append(F.when(~nothing, text))
    return F.coalesce(*found, F.lit(""))


def _first(record: Value, *names: str) -> str:
    """The first member that counts as something, as text."""
    found = [record.member(name).text_if_truthy() for name in names if not record.member(name).never]
    return "coalesce(" + ", ".join([*found, "''"]) + ")"


def _joined(value: Value) -> str:
    """A list as one cell, an object as JSON, anything else as text; nothing as the empty string."""
    if not value.dynamic:
        return f"coalesce({compact_sql(value.each(Value.text), LIST_LIMIT)}, '')" if isinstance(value.kind, T.ArrayType) else value.text()
    items = Value(f"try_variant_get({value.sql}, '$', 'array<variant>')", T.ArrayType(T.VariantType()))
    listed = compact_sql(items.each(Value.text), LIST_LIMIT)
    return f"CASE WHEN {items.sql} IS NOT NULL THEN {listed} WHEN {value.truthy()} THEN {value.text()} ELSE '' END"


def _names(value: Value) -> str:
    """The names of a list of objects in one cell."""
    objects = value.items().only(Value.is_object)
    return compact_sql(objects.each(lambda x: _first(x, "display_name", "name", "title")), LIST_LIMIT)


def _payload(record: Value) -> Value:
    """The ``dcat`` object, else the record itself if it looks like one, else nothing."""
    dcat = record.member("dcat")
    marks = [m.truthy() for m in (record.member(name) for name in ("@type", "distribution", "keyword")) if not m.never]
    if not marks:
        return dcat
    alike = " OR ".join(marks)
    if dcat.never:
        return Value(f"CASE WHEN {alike} THEN {record.sql} END", record.kind)
    return Value(
        f"CASE WHEN {dcat.is_object()} THEN {dcat.as_variant()} WHEN {alike} THEN {record.as_variant()} END", T.VariantType()
    )


def _own_distributions(dcat: Value) -> Value:
    """The distributions of a payload: one object or the objects of a list."""
    one, more = dcat.member("distribution"), dcat.member("distributions")
    return first_list((one.truthy(), one.one_or_more()), (None, more.one_or_more())).only(Value.is_object)


def _extra_pairs(extras: Value) -> Value:
    """Extras as a list of ``k, v``: the members of an object, or the keys and values of a list of objects."""
    items = extras.items().only(lambda x: f"({x.is_object()} AND {x.member('key').there()})")
    value = Value("x", items.kind.elementType).member("value")
    held = T.StringType() if value.never else value.kind
    kind = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", held)]))

    def pair(x: Value) -> str:
        own = "CAST(NULL AS STRING)" if value.never else x.member("value").sql
        return f"named_struct('k', {x.member('key').text()}, 'v', {own})"

    listed = items.each(pair)
    if extras.dynamic:
        v = fresh()
        entries = f"map_entries(try_variant_get({extras.sql}, '$', 'map<string,variant>'))"
        members = f"transform({entries}, {v} -> named_struct('k', {v}.key, 'v', {v}.value))"
        return Value(f"CASE WHEN {extras.is_object()} THEN {members} ELSE {listed} END", kind)
    return Value(listed, kind)


def _extra(pairs: Value, *names: str) -> Value:
    """The last value of the first key that is there."""
    x, parts = fresh(), ""
    for name in names:
        held = f"filter({pairs.sql}, {x} -> {x}.k = {literal(name)})"
        parts += f" WHEN size({held}) > 0 THEN try_element_at({held}, -1).v"
    return Value(f"CASE{parts} END", pairs.kind.elementType["v"].dataType)


def _extras_json(pairs: Value) -> str:
    """All extras as a JSON object of texts in order of key, of equal keys the last."""
    x, i, y = fresh(), fresh(), fresh()
    later = f"slice({pairs.sql}, {i} + 2, greatest(0, size({pairs.sql}) - {i} - 1))"
    last = Value(f"filter({pairs.sql}, ({x}, {i}) -> NOT exists({later}, {y} -> {y}.k = {x}.k))", pairs.kind)
    texts = last.each(lambda p: f"named_struct('k', {p.member('k').sql}, 'v', {p.member('v').text()})")
    return f"coalesce(to_json(map_from_entries(array_sort({texts}))), '{{}}')"


def _record_of(df: DataFrame, record: str, keep: tuple[str, ...]) -> tuple[DataFrame, Value]:
    """The rows with the record in ``_r``, null where it is no object."""
    value = of(df, record)
    held = f"CASE WHEN {value.is_object()} THEN {value.sql} END" if value.dynamic else value.sql
    return df.select(*keep, F.expr(held).alias("_r")), Value("_r", value.kind)


def flatten_records(df: DataFrame, record: str, *keep: str) -> DataFrame:
    """One row of 48 columns for each record; ``keep`` names further columns of ``df`` to carry along.

    ``record`` is a struct or a VARIANT. Records that are null or no objects give a row of empty cells. All columns are
    strings but the two counts. Contract checks are separate (``record_violations``), so that one odd record does not
    stop a run.
    """
    base, r = _record_of(df, record, keep)

    def hold(name: str, value: Value) -> Value:
        """A value that is worked out once under a name of its own."""
        nonlocal base
        if value.never:
            return value
        base = base.withColumn(name, F.expr(value.sql))
        return Value(name, value.kind)

    d = hold("_d", _payload(r))
    x = hold("_x", _extra_pairs(r.member("extras")))
    own, listed = r.member("resources"), r.member("distributions")
    found = first_list((own.truthy(), own.items()), (listed.truthy(), listed.items()), (None, _own_distributions(d)))
    items = hold("_i", found.only(Value.is_object))
    keyword, extra_keyword = d.member("keyword"), _joined(_extra(x, "keyword", "keywords"))
    keywords = extra_keyword if keyword.never else f"CASE WHEN {keyword.there()} THEN {_joined(keyword)} ELSE {extra_keyword} END"
    base = base.withColumn("_k", F.expr(keywords))

    def cells(*names: str) -> str:
        return compact_sql(items.each(lambda item: _first(item, *names)), LIST_LIMIT)

    def chain(*values: Value) -> str:
        """The first value that is there, even if null or empty."""
        return "coalesce(" + ", ".join([*(v.text_if_there() for v in values), "''"]) + ")"

    def plain(name: str) -> str:
        return d.member(name).text()

    def of_object(holder: Value, name: str) -> str:
        return f"CASE WHEN {holder.is_object()} THEN {_joined(holder.member(name))} ELSE '' END"

    org, contact = r.member("organization"), d.member("contactPoint")
    publisher_name = of_object(d.member("publisher"), "name")
    columns = {
        "id": either(_first(r, "id"), plain("identifier")),
        "name": _first(r, "name"),
        "title": either(_first(r, "title"), plain("title")),
        "notes": either(_first(r, "notes", "description"), plain("description")),
        "organization_title": either(_first(org, "title"), publisher_name),
        "organization_name": either(_first(org, "name"), publisher_name),
        "organization_id": _first(org, "id"),
        "groups": _names(r.member("groups")),
        "tags": either(_names(r.member("tags")), "_k"),
        "license_title": either(_first(r, "license_title"), plain("license")),
        "metadata_created": _first(r, "metadata_created"),
        "metadata_modified": either(_first(r, "metadata_modified"), plain("modified")),
        "url": either(_first(r, "url"), plain("landingPage")),
        "extras": _extras_json(x),
        "resources_count": f"size({items.sql})",
        "resource_names": cells("name", "title"),
        "resource_descriptions": cells("description"),
        "resource_formats": cells("format"),
        "resource_media_types": cells("mimetype", "mediaType", "media_type"),
        "resource_urls": cells("url", "downloadURL", "download_url", "accessURL", "access_url"),
        "dcat_type": chain(d.member("@type"), r.member("@type")),
        "dcat_title": chain(d.member("title"), r.member("dct:title"), r.member("title")),
        "dcat_description": chain(d.member("description"), r.member("dct:description"), r.member("description"), r.member("notes")),
        "dcat_identifier": chain(d.member("identifier"), r.member("identifier")),
        "dcat_accessLevel": plain("accessLevel"),
        "dcat_modified": chain(d.member("modified"), _extra(x, "modified", "date_modified")),
        "dcat_issued": plain("issued"),
        "dcat_keyword": "_k",
        "dcat_theme": _joined(d.member("theme")),
        "dcat_bureauCode": _joined(d.member("bureauCode")),
        "dcat_programCode": _joined(d.member("programCode")),
        "dcat_publisher_name": either(publisher_name, _extra(x, "publisher", "publisher_name").text()),
        "dcat_contactPoint_fn": of_object(contact, "fn"),
        "dcat_contactPoint_hasEmail": either(of_object(contact, "hasEmail"), _extra(x, "contactPoint.hasEmail", "contact_email").text()),
        "dcat_landingPage": plain("landingPage"),
        "dcat_license": plain("license"),
        "dcat_rights": plain("rights"),
        "dcat_spatial": plain("spatial"),
        "dcat_temporal": plain("temporal"),
        "distribution_count": "resources_count",
        "distribution_titles": "resource_names",
        "distribution_descriptions": "resource_descriptions",
        "distribution_formats": "resource_formats",
        "distribution_media_types": "resource_media_types",
        "distribution_download_urls": cells("downloadURL", "download_url"),
        "distribution_access_urls": cells("accessURL", "access_url", "url"),
        "harvest_record": r.member("harvest_record").text(),
        "harvest_record_raw": r.member("harvest_record_raw").text(),
    }
    # A column that is named in the same list is that column: several carry the same values under two names.
    quoted = [f"`{name}`" for name in keep]
    return base.selectExpr(*quoted, *(f"{sql} AS `{name}`" for name, sql in columns.items()))


def flatten_distributions(df: DataFrame, record: str, *keep: str) -> DataFrame:
    """One row of 12 columns for each distribution of each record, with its place from 0, unusable items counted."""
    base, r = _record_of(df, record, keep)
    d = _payload(r)
    listed, own = r.member("distributions"), r.member("resources")
    items = first_list((listed.truthy(), listed.items()), (own.truthy(), own.items()), (None, _own_distributions(d)))
    quoted = [f"`{name}`" for name in keep]
    rows = base.selectExpr(
        *quoted,
        f"{either(_first(r, 'id'), _first(d, 'identifier'))} AS dataset_id",
        f"{either(_first(r, 'title'), _first(d, 'title'))} AS dataset_title",
        f"posexplode({items.sql}) AS (distribution_index, _i)",
    )
    item = Value("_i", items.kind.elementType)
    names = {
        "distribution_title": ("title", "name"),
        "distribution_description": ("description",),
        "format": ("format",),
        "mediaType": ("mediaType", "mimetype", "media_type"),
        "downloadURL": ("downloadURL", "download_url"),
        "accessURL": ("accessURL", "access_url", "url"),
        "conformsTo": ("conformsTo",),
        "describedBy": ("describedBy",),
        "describedByType": ("describedByType",),
    }
    cells = [f"{_first(item, *keys)} AS `{name}`" for name, keys in names.items()]
    return rows.where(item.is_object()).selectExpr(*quoted, "dataset_id", "dataset_title", "distribution_index", *cells)


def record_violations(df: DataFrame, record: str) -> Column:
    """Names of the members of a record that have another kind than its contract says; empty where all is well."""
    r = F.col(record)
    kinds = {name: ["STRING"] for name in "id name title notes license_title metadata_created metadata_modified url".split()}
    kinds |= {"organization": ["OBJECT"], "groups": ["ARRAY"], "tags": ["ARRAY"], "resources": ["ARRAY"], "extras": ["ARRAY", "OBJECT"]}
    wrong = []
    for name, allowed in kinds.items():
        kind = F.schema_of_variant(member(r, name))
        fine = kind.isNull() | (kind == "VOID")
        for start in allowed:
            fine = fine | kind.startswith(start)
        wrong.append(F.when(~fine, name))
    return F.filter(F.array(*wrong), lambda x: x.isNotNull())


def field_examples(df: DataFrame, record: str, order: str) -> DataFrame:
    """``input_field, example_value``: every member name with its first value, the keys of extras and the members of
    resources included. ``order`` names the column that says which record comes first."""
    pairs = F.map_entries(F.try_variant_get(F.col(record), "$", "map<string,variant>"))
    top = df.select(order, F.posexplode(pairs).alias("_i", "_e")).select(
        order, "_i", F.lit(0).alias("_j"), F.col("_e.key").alias("input_field"), F.col("_e.value").alias("_v")
    )
    extras = (
        df.select(order, F.posexplode(list_items(member(F.col(record), "extras"))).alias("_j", "_e"))
        .where(is_object(F.col("_e")) & has(F.col("_e"), "key"))
        .select(order, F.lit(10_000).alias("_i"), "_j", as_text(member(F.col("_e"), "key")).alias("input_field"), member(F.col("_e"), "value").alias("_v"))
    )
    inner = F.map_entries(F.try_variant_get(F.col("_e"), "$", "map<string,variant>"))
    resources = (
        df.select(order, F.posexplode(list_items(member(F.col(record), "resources"))).alias("_j", "_e"))
        .where(is_object(F.col("_e")))
        .select(order, "_j", F.explode(inner).alias("_m"))
        .select(order, F.lit(20_000).alias("_i"), "_j", F.concat(F.lit("distribution."), F.col("_m.key")).alias("input_field"), F.col("_m.value").alias("_v"))
    )
    every = top.unionByName(extras).unionByName(resources).withColumn("example_value", F.substring(as_text(F.col("_v")), 1, 300))
    return every.groupBy("input_field").agg(F.min_by("example_value", F.struct(order, "_i", "_j")).alias("example_value"))

"""Contract-driven annotation: a contract is compiled into Column expressions."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.plans.versions import Versions

Contract = dict[str, Any]


def load_contract(path: str) -> Contract | None:
    """A contract from a JSON file on the driver; missing or bad files give none."""
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as file:
        try:
            found = json.load(file)
        except ValueError:
            return None
    return found if isinstance(found, dict) else None


def contract_dir(preferred: list[str | None], starts: list[str], names: tuple[str, ...] = ("runtime_contracts",)) -> str | None:
    """The first folder that exists of the preferred ones, then of those called ``names`` beside or above each start."""
    places = [os.path.expanduser(p.strip()) for p in preferred if p and p.strip()]
    for start in starts:
        base = start if os.path.isdir(start) else os.path.dirname(start)
        above = [os.path.abspath(base)]
        while os.path.dirname(above[-1]) != above[-1]:
            above.append(os.path.dirname(above[-1]))
        places += [os.path.join(folder, name) for folder in above for name in names]
    return next((os.path.realpath(p) for p in places if os.path.isdir(p)), None)


def find_contract(repo: str, preferred: list[str | None], starts: list[str], names: tuple[str, ...] = ("runtime_contracts",)) -> Contract | None:
    """The contract of a repo in the folder that contract_dir finds, read once on the driver."""
    folder = contract_dir(preferred, starts, names)
    return load_contract(os.path.join(folder, f"{repo}.json")) if folder else None


def _texts(values: Any) -> list[str]:
    return [str(v).strip() for v in values if str(v).strip()] if isinstance(values, list) else []


def field_spec(contract: Contract | None, key: str) -> dict[str, Any] | None:
    """required_fields, optional_fields and field_enums of an event model's own key, without blanks and what is no list; None where there is none."""
    specs = (contract or {}).get("event_model_field_specs")
    found = specs.get(key.strip()) if isinstance(specs, dict) else None
    if not isinstance(found, dict):
        return None
    enums = found.get("field_enums")
    kept = {str(n).strip(): _texts(v) for n, v in enums.items() if str(n).strip() and isinstance(v, list)} if isinstance(enums, dict) else {}
    return {"required_fields": _texts(found.get("required_fields")), "optional_fields": _texts(found.get("optional_fields")), "field_enums": kept}


def _lookup(values: dict[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.nullif(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(""))


def _drop_empty(entries: dict[str, Column]) -> Column:
    whole = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    return F.map_filter(whole, lambda _, v: v.isNotNull() & (v != ""))


def annotate(articles: DataFrame, contract: Contract, sources: DataFrame, default_event: str | None = None, repo: str | None = None) -> DataFrame:
    """Adds ontology (map) and evidence_policy_ids by the article's source; sources (name, event_model, role) is a small dimension.

    ``repo`` is the caller's name, else the contract's; a source's role is mapped by its own name, else by its role.

    Articles of sources without an event model take ``default_event`` where it is given,
    and are marked in used_default.

    The join is left to the optimizer, which broadcasts the dimension if its size allows.
    """
    dim = sources.select(F.trim("name").alias("_name"), F.col("event_model").alias("_event"), F.col("role").alias("_role"))
    rows = articles.join(dim, F.trim("source") == F.col("_name"), "left")
    if default_event is not None:
        lacking = F.coalesce(F.trim("_event"), F.lit("")) == ""
        rows = rows.withColumn("used_default", lacking).withColumn("_event", F.when(F.col("used_default"), default_event).otherwise(F.col("_event")))
    entries = {
        "repo": F.lit(repo or contract.get("repo", "")),
        "category": F.lit(contract.get("category", "")),
        "ontology_version": F.lit(contract.get("ontology_version", "")),
        "source_event_model": F.col("_event"),
        "source_role_id": F.coalesce(*[_lookup(contract.get("source_role_mappings", {}), c) for c in (F.trim("source"), F.col("_role"))]),
        "event_model_id": _lookup(contract.get("event_model_mappings", {}), F.col("_event")),
    }
    evidence = F.array(*[F.lit(x) for x in contract.get("evidence_policy_ids") or []]).cast("array<string>")
    return rows.withColumn("ontology", _drop_empty(entries)).withColumn("evidence_policy_ids", evidence).drop("_name", "_event", "_role")


def payload(spec: dict[str, Any], columns: list[str], overrides: dict[str, str | None] | None = None) -> Column:
    """Declared fields with values: an override, else the article's own attribute; empty ones, and fields without a column, are absent."""
    own = {"source_name": "source", "headline": "title", "source_url": "link", "summary": "summary", "published_at": "event_ts"}
    names = list(dict.fromkeys([*spec.get("required_fields", []), *spec.get("optional_fields", [])]))
    overrides = overrides or {}
    names = [n for n in names if n in overrides or own.get(n, n) in columns]
    entries = {n: F.lit(overrides[n]).cast("string") if n in overrides else F.trim(F.col(own.get(n, n)).cast("string")) for n in names}
    return _drop_empty(entries)


OVERRIDES = "map<string,string>"


def payloads(articles: DataFrame, contract: Contract, sources: DataFrame, explicit: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Annotated articles with event_model_payload (map) and violation (struct of field, value, allowed).

    Overrides (source, overrides: a map) come from ``explicit`` where it is given, even if it
    names no source, else from ``sources`` (name, overrides).  They replace or complete the
    article's own fields; an override that is null or empty takes the field out.  Only articles with
    a contracted event model have a payload.  A value outside its vocabulary leaves no payload but a
    violation, and fails the write if ``strict``.  The dimension is joined by source; the
    optimizer broadcasts it if its size allows.
    """
    given = sources.select(F.col("name").alias("source"), "overrides") if explicit is None else explicit.select("source", "overrides")
    dim = given.select(F.trim("source").alias("_name"), F.col("overrides").cast(OVERRIDES).alias("_over")).where("_over is not null")
    rows = articles.join(dim, F.trim("source") == F.col("_name"), "left")
    event, over = F.try_element_at("ontology", F.lit("source_event_model")), F.coalesce("_over", F.create_map().cast(OVERRIDES))
    found, wrong = F.lit(None).cast(OVERRIDES), F.lit(None).cast("struct<field:string,value:string,allowed:array<string>>")
    for key in contract.get("event_model_mappings", {}):
        spec = contract.get("event_model_field_specs", {}).get(key)
        if spec is None:
            continue
        declared = list(dict.fromkeys([*spec.get("required_fields", []), *spec.get("optional_fields", [])]))
        own = F.map_filter(payload(spec, articles.columns), lambda k, _: ~F.map_contains_key(over, k))
        set_ = F.map_filter(over, lambda k, v: k.isin(*declared) & v.isNotNull() & (F.trim(v) != ""))  # noqa: B023
        values = F.map_concat(own, F.transform_values(set_, lambda _, v: F.trim(v)))
        bad = enum_violations(values, spec)
        vocabulary = F.create_map(*[x for name, allowed in spec.get("field_enums", {}).items() for x in (F.lit(name), F.array(*[F.lit(a) for a in allowed]))]) if spec.get("field_enums") else F.lit(None).cast("map<string,array<string>>")
        told = F.when(bad.isNotNull(), F.struct(bad["field"].alias("field"), bad["value"].alias("value"), F.try_element_at(vocabulary, bad["field"]).alias("allowed")))
        mine = (event == key) & F.map_contains_key("ontology", "event_model_id")
        found = F.when(mine, F.when(F.size(values) > 0, checked_payload(values, bad, strict))).otherwise(found)
        wrong = F.when(mine, told).otherwise(wrong)
    return rows.withColumns({"event_model_payload": found, "violation": wrong}).drop("_name", "_over")


def enum_violations(values: Column, spec: dict[str, Any]) -> Column:
    """Struct (field, value) of the first field whose value is not in its vocabulary, else null."""
    found = []
    for name, allowed in spec.get("field_enums", {}).items():
        value = F.try_element_at(values, F.lit(name))
        found.append(F.when(value.isNotNull() & ~value.isin(*allowed), F.struct(F.lit(name).alias("field"), value.alias("value"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<field:string,value:string>")


def list_payload(spec: dict[str, Any], columns: list[str]) -> Column:
    """Declared fields that are lists: the article's own, and as tags the sorted names of its entities; empty ones are absent."""
    names = dict.fromkeys([*spec.get("required_fields", []), *spec.get("optional_fields", [])])
    own = {n: F.col(n).cast("array<string>") for n in spec.get("list_fields", []) if n in names and n in columns}
    if "tags" in names and "matched_entities" in columns:
        own["tags"] = F.array_sort(F.array_distinct(F.map_keys("matched_entities")))
    if not own:
        return F.create_map().cast("map<string,array<string>>")
    return F.map_filter(F.create_map(*[x for n, c in own.items() for x in (F.lit(n), c)]), lambda _, v: F.size(v) > 0)


def list_violations(values: Column, spec: dict[str, Any]) -> Column:
    """Struct (field, value) of the first list entry that is not in its field's vocabulary, else null."""
    found = []
    for name, allowed in spec.get("field_enums", {}).items():
        wrong = F.filter(F.try_element_at(values, F.lit(name)), lambda v: ~v.isin(*allowed))  # noqa: B023
        found.append(F.when(F.size(wrong) > 0, F.struct(F.lit(name).alias("field"), F.get(wrong, F.lit(0)).alias("value"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<field:string,value:string>")


def checked_payload(values: Column, violation: Column, strict: bool = False) -> Column:
    """The payload where nothing violates it; else the write fails if strict, and there is no payload if not."""
    if not strict:
        return F.when(violation.isNull(), values)
    told = F.concat(F.lit("value '"), violation["value"], F.lit("' not allowed for "), violation["field"])
    return F.when(violation.isNotNull(), F.raise_error(told)).otherwise(values)


def summary_metadata(contract: Contract | None, repo: str, category: str | None = None) -> dict[str, Any] | None:
    """What a summary says of its contract: ids sorted and distinct, mappings, and no empty entries; None without a contract."""
    if contract is None:
        return None
    events, roles = contract.get("event_model_mappings") or {}, contract.get("source_role_mappings") or {}
    told = {
        "repo": repo,
        "category": str(contract.get("category") or category or "").strip(),
        "ontology_version": str(contract.get("ontology_version") or "").strip(),
        "event_model_ids": sorted(set(events.values())),
        "event_model_mappings": events,
        "entity_type_hints": contract.get("entity_type_hints") or [],
        "source_role_ids": sorted(set(roles.values())),
        "source_role_mappings": roles,
        "evidence_policy_ids": contract.get("evidence_policy_ids") or [],
    }
    return {k: v for k, v in told.items() if v}


def validate(ontology: Column, values: Column, contract: Contract) -> Column:
    """Messages of what contradicts the contract; no ontology is valid."""
    event, role = F.try_element_at(ontology, F.lit("event_model_id")), F.try_element_at(ontology, F.lit("source_role_id"))
    events = contract.get("event_model_mappings", {})
    messages = [
        F.when(event.isNotNull() & ~event.isin(*events.values()), F.concat(F.lit("event_model_id '"), event, F.lit("' not declared in contract.event_model_mappings"))),
        F.when(
            role.isNotNull() & ~role.isin(*contract.get("source_role_mappings", {}).values()),
            F.concat(F.lit("source_role_id '"), role, F.lit("' not declared in contract.source_role_mappings")),
        ),
    ]
    first_key = {v: k for k, v in reversed(events.items())}
    for event_id, key in first_key.items():
        for name in contract.get("event_model_field_specs", {}).get(key, {}).get("required_fields", []):
            lacking = (event == event_id) & (F.size(values) > 0) & ~F.map_contains_key(values, name)
            messages.append(F.when(lacking, F.lit(f"event_model_payload missing required field '{name}' for '{event_id}'")))
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def violations(articles: DataFrame, values: Column, contract: Contract, repo: str) -> DataFrame:
    """Rows (repo, link, source, errors) of the articles whose ontology contradicts the contract."""
    rows = articles.select(F.lit(repo).alias("repo"), "link", "source", validate(F.col("ontology"), values, contract).alias("errors"))
    return rows.where(F.size("errors") > 0)


def gated(articles: DataFrame, values: Column, contract: Contract | None, strict: bool = False) -> DataFrame:
    """The articles to store: all of them, but a strict gate fails the write at the first violation; without a contract nothing is checked."""
    if contract is None or not strict:
        return articles
    errors = validate(F.col("ontology"), values, contract)
    failed = F.raise_error(F.concat(F.lit("ontology validation failed for "), "link", F.lit(": "), F.array_join(errors, "; ")))
    return articles.withColumn("link", F.when(F.size(errors) > 0, failed).otherwise(F.col("link")))


def stored_backfill(table: Versions, changed: DataFrame) -> int | None:
    """Puts changed ontologies (key, ontology) into a stored table as a new version that rewrites their buckets only.

    Keys that the table doesn't hold are left out; without changes there is no new version.
    """
    new = changed.select(F.col(table.key).alias("_key"), F.col("ontology").alias("_new"))

    def merged(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        if old is None:
            return rows.where(F.lit(False))
        old = old.drop("bucket")
        both = old.join(rows, old[table.key] == rows["_key"], "left")
        return both.select(*[F.when(F.col("_key").isNotNull(), F.col("_new")).otherwise(old["ontology"]).alias(c) if c == "ontology" else old[c] for c in old.columns])

    return table.change(new.withColumn(table.key, F.col("_key")), merged)


def backfill(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ontology changed, and counters of all rows.

    Counters: scanned, updated, with_event_model_id, with_event_model_payload (a column
    ``event_model_payload`` of ``new`` that isn't empty) and default_fallback_applied (its
    ``used_default``, where there is an event model); without these columns they are 0.
    """
    event = F.map_contains_key("ontology", "event_model_id").alias("has_event")
    paid = F.size("event_model_payload") > 0 if "event_model_payload" in new.columns else F.lit(False)
    default = F.col("used_default") if "used_default" in new.columns else F.lit(False)
    told = new.select(key, "ontology", F.map_entries("ontology").alias("is"), event, paid.alias("paid"), default.alias("by_default"))
    both = old.select(key, F.map_entries("ontology").alias("was")).join(told, key)
    changed = ~F.array_sort("was").eqNullSafe(F.array_sort("is"))
    counters = both.agg(
        F.count("*").alias("scanned"),
        F.count_if(changed).alias("updated"),
        F.count_if("has_event").alias("with_event_model_id"),
        F.count_if("paid").alias("with_event_model_payload"),
        F.count_if(F.col("has_event") & F.col("by_default")).alias("default_fallback_applied"),
    )
    return both.where(changed).select(key, "ontology"), counters

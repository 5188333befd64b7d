"""The contract of canonical papers as JSON lines: each fault of each line as a row, and counts of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import canonical

#: Fields of a canonical paper that its observations don't have under that name, and their types.
OWN = {
    **dict.fromkeys(["canonical_id", "reconciliation_key", "title"], "string"),
    "updated_at": "timestamp",
    "doc_ids": "array<string>",
    "sources": "array<struct>",
    **dict.fromkeys(["source_count", "unique_source_count"], "bigint"),
}
NOT_KEPT = ["doc_id", "source", "source_id", "source_record_id", "source_record_url", "source_api_url", "raw_source_name", "canonical_url", "updated_source_at", "ingested_at"]
FIELDS = {**{n: t for n, t in canonical.SCHEMA.items() if n not in NOT_KEPT}, **OWN}
REQUIRED = ["canonical_id", "title", "reconciliation_key"]


def _at(name: str) -> Column:
    return F.try_variant_get("_v", f"$.{name}", "variant")


def _fits(name: str, kind: str) -> Column:
    """Whether a field that is there and not null has its type; a whole number may be written as text, a day or time is text."""
    found, said = F.schema_of_variant(_at(name)), F.try_variant_get("_v", f"$.{name}", "string")
    if kind in ("int", "bigint"):
        return (found == "BIGINT") | ((found == "STRING") & said.rlike(r"^\s*[+-]?[0-9]+\s*$"))
    if kind == "double":
        return found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    if kind == "timestamp":
        return (found == "STRING") & F.try_to_timestamp(said).isNotNull()
    if kind.startswith("array"):
        return found.startswith("ARRAY")
    return found.startswith("OBJECT") if kind.startswith("map") else found == kind.upper()


def faults(lines: DataFrame, key: str, line: str = "value", fields: dict[str, str] | None = None, required: list[str] | None = None) -> DataFrame:
    """(key, rule, detail) for each fault of each line; blank and null lines are skipped.

    Rules of a line: unreadable (not JSON, or a key twice), not_an_object, missing_id (detail: null), extra_field and
    wrong_type (detail: the field), missing_field, ids_not_a_list, repeated_doc_id (the id). Rules of all lines:
    repeated_id and doc_id_of_several (the id; key is null), each id once. Only ids go through a shuffle, with their
    repeats told apart before they meet.
    """
    fields, required = fields or FIELDS, required or REQUIRED
    rows = lines.select(F.col(key).alias("_key"), F.col(line).alias("_line")).where(F.trim(F.coalesce("_line", F.lit(""))) != "")
    rows = rows.withColumn("_v", F.try_parse_json("_line")).withColumn("_kind", F.coalesce(F.schema_of_variant("_v"), F.lit("")))
    whole = F.col("_kind").startswith("OBJECT")
    fault = lambda rule, detail=None: F.struct(F.lit(rule).alias("rule"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    if_so = lambda test, *what: F.when(whole & test, F.array(fault(*what)))
    ids = F.try_variant_get("_v", "$.doc_ids", "array<string>")
    said = F.filter(ids, lambda x: x.isNotNull() & (x != ""))
    repeated = F.array_distinct(F.filter(said, lambda x: F.size(F.filter(said, lambda y: y == x)) > 1))
    known = F.array(*[F.lit(n) for n in fields])
    null = lambda n: _at(n).isNull() | F.is_variant_null(_at(n))
    paper = F.nullif(F.try_variant_get("_v", "$.canonical_id", "string"), F.lit(""))
    found = [
        F.when(F.col("_v").isNull(), F.array(fault("unreadable"))),
        F.when(F.col("_v").isNotNull() & ~whole, F.array(fault("not_an_object"))),
        if_so(paper.isNull(), "missing_id"),
        F.when(whole, F.transform(F.array_except(F.json_object_keys("_line"), known), lambda n: fault("extra_field", n))),
        if_so(~null("doc_ids") & ~F.schema_of_variant(_at("doc_ids")).startswith("ARRAY"), "ids_not_a_list"),
        F.when(whole, F.transform(repeated, lambda x: fault("repeated_doc_id", x))),
        *[if_so(null(n), "missing_field", F.lit(n)) for n in required if n != "canonical_id"],
        *[if_so(~null(n) & ~F.coalesce(_fits(n, t), F.lit(False)), "wrong_type", F.lit(n)) for n, t in fields.items() if n != "doc_ids"],
    ]
    none = F.array().cast("array<struct<rule:string,detail:string>>")
    each = rows.select("_key", F.explode(F.concat(*[F.coalesce(x, none) for x in found])).alias("x")).select(F.col("_key").alias(key), "x.rule", "x.detail")
    papers = rows.where(whole).select(paper.alias("paper"), said.alias("ids")).where("paper is not null")
    twice = papers.groupBy("paper").count().where("count > 1").select(F.lit("repeated_id").alias("rule"), F.col("paper").alias("detail"))
    several = papers.select("paper", F.explode("ids").alias("id")).groupBy("id").agg(F.min("paper").alias("a"), F.max("paper").alias("z")).where("a <> z").select(F.lit("doc_id_of_several").alias("rule"), F.col("id").alias("detail"))
    kind = lines.schema[key].dataType
    return reduce(DataFrame.unionByName, [x.select(F.lit(None).cast(kind).alias(key), "rule", "detail") for x in (twice, several)], each)


def counts(found: DataFrame, key: str) -> DataFrame:
    """(rule, detail, faults, lines): how often, and in how many lines, each rule is broken; detail only for rules about fields."""
    detail = F.when(F.col("rule").isin("extra_field", "wrong_type", "missing_field"), F.col("detail"))
    return found.groupBy("rule", detail.alias("detail")).agg(F.count(F.lit(1)).alias("faults"), F.countDistinct(key).alias("lines"))

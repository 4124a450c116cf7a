"""Parsing and building of prompts and replies. JSON goes through VARIANT, so one odd element doesn't spoil the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: What tells a family of models by its address or its name; the tags and fences around a JSON reply; the
#: headings of a prompt.
THINKING = ("dashscope", "qwen")
JSON_TAGS, FENCES = "^<json>|</json>$", r"^```(?:json)?\s*|\s*```$"
GLOSSARY, HINTS = "Glossary Tables", "Contextual Hints for Better Translation"


def clean_json(text: Column) -> Column:
    """Without <json> tags and code fences."""
    bare = T.strip(F.regexp_replace(T.strip(F.coalesce(text, F.lit(""))), JSON_TAGS, ""))
    return T.strip(F.regexp_replace(bare, FENCES, ""))


def section(prompt: Column, heading: str) -> Column:
    """Body under a `## heading` up to the next one; empty if there is none."""
    return T.strip(F.regexp_extract(prompt, rf"(?ms)^## \Q{heading}\E\s*$(.*?)(?=^## |\z)", 1))


def tail(prompt: Column, marker: str = T.SINGLE_MARKER) -> Column:
    """What follows the marker; null without it."""
    at = F.locate(marker, prompt)
    return F.when(at > 0, T.strip(prompt.substr(at + len(marker), F.length(prompt))))


def glossary_targets(markdown: Column) -> Column:
    """Targets in the two-cell rows of a markdown table."""
    rows = F.transform(F.split(markdown, r"\R"), lambda r: F.transform(F.split(F.regexp_replace(T.strip(r), r"^\|+|\|+$", ""), r"\|"), T.strip))
    good = F.filter(rows, lambda c: (F.size(c) == 2) & (c[0] != "") & (c[0] != T.GLOSSARY_HEADER) & ~c[0].rlike("^[-: ]+$"))
    return F.array_distinct(F.transform(good, lambda c: c[1]))


def items(rows: DataFrame, by: str, reply: str) -> DataFrame:
    """by, seq, item (variant): the elements of a reply, a list or one object; those without an id, and bad replies, are none."""
    parsed = rows.select(by, F.try_parse_json(clean_json(F.col(reply))).alias("v")).where("v IS NOT NULL")
    listed = parsed.select(by, F.expr("CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN CAST(v AS array<variant>) ELSE array(v) END AS parts"))
    return listed.select(by, F.posexplode("parts").alias("seq", "item")).where("schema_of_variant(item) LIKE 'OBJECT%' AND try_variant_get(item, '$.id', 'int') IS NOT NULL")


def batch_prompt(rows: DataFrame, by: str, prompt: str) -> DataFrame:
    """by, id, input: the rows of a batch prompt, after its marker. A prompt without the marker, or whose rest isn't a list of
    objects that all have the key `id`, gives none; the last of equal ids counts. An id that is no whole number is null."""
    read = rows.select(by, F.try_parse_json(tail(F.col(prompt), T.BATCH_MARKER)).alias("v")).where("schema_of_variant(v) LIKE 'ARRAY%'")
    parts = read.select(by, F.expr("CAST(v AS array<variant>)").alias("parts"))
    good = F.expr("forall(parts, x -> coalesce(schema_of_variant(x) LIKE 'OBJECT%' AND try_variant_get(x, '$.id', 'variant') IS NOT NULL, false))")
    rowed = parts.where(good).select(by, F.posexplode("parts").alias("seq", "item"))
    got = rowed.select(by, "seq", F.expr("try_variant_get(item, '$.id', 'int')").alias("id"), F.expr("try_variant_get(item, '$.input', 'string')").alias("input"))
    own = F.when(F.col("id").isNull(), F.col("seq"))  # ids that can't be compared stay apart
    return got.groupBy(by, "id", own.alias("own")).agg(F.max_by("input", "seq").alias("input")).drop("own")


def batch_output(rows: DataFrame, by: str, reply: str) -> DataFrame:
    """by, id, output: `input` stands in only where the key `output` is absent; values that aren't strings are skipped; the last
    of equal ids counts."""
    got = items(rows, by, reply).withColumn("id", F.expr("try_variant_get(item, '$.id', 'int')"))
    has = F.expr("schema_of_variant(item) RLIKE '\\\\boutput: '")
    value = F.when(has, F.expr("try_variant_get(item, '$.output', 'variant')")).otherwise(F.expr("try_variant_get(item, '$.input', 'variant')"))
    got = got.withColumn("value", value).where("schema_of_variant(value) = 'STRING'")
    return got.groupBy(by, "id").agg(F.max_by(F.expr("variant_get(value, '$', 'string')"), "seq").alias("output"))


def reviews(rows: DataFrame, by: str, reply: str) -> DataFrame:
    """by, id, verdict, problems, output: verdict ok unless given, in lower case; one problem may stand by itself; blank ones
    go; an output that isn't a string is empty."""
    get = "try_variant_get(item, '$.{0}', '{1}')"
    kind = "schema_of_variant(try_variant_get(item, '$.{0}', 'variant'))"
    problems = F.expr(f"CASE WHEN {kind.format('problems')} = 'STRING' THEN array({get.format('problems', 'string')}) WHEN {kind.format('problems')} LIKE 'ARRAY%' THEN {get.format('problems', 'array<string>')} END")
    got = items(rows, by, reply).select(
        by,
        "seq",
        F.expr(get.format("id", "int")).alias("id"),
        F.lower(F.coalesce(F.expr(get.format("verdict", "string")), F.lit("ok"))).alias("verdict"),
        F.filter(F.coalesce(problems, F.array().cast("array<string>")), lambda p: T.strip(p) != "").alias("problems"),
        F.coalesce(F.expr(f"CASE WHEN {kind.format('output')} = 'STRING' THEN {get.format('output', 'string')} END"), F.lit("")).alias("output"),
    )
    last = got.groupBy(by, "id").agg(F.max_by(F.struct("verdict", "problems", "output"), "seq").alias("_last"))
    return last.select(by, "id", "_last.*")


def dump_output(rows: DataFrame, by: str) -> DataFrame:
    """by, reply: a JSON array of {id, output}, sorted by id."""
    return rows.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "output")))).alias("reply"))


def review_prompt(payload: Column, glossary: Column, context: Column) -> Column:
    """The reviewer's input: context and glossary where there are any, then the rows as JSON."""
    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), body))
    return F.concat_ws("\n\n", part("Context", context), part("Glossary", glossary), F.concat(F.lit("## Rows\n"), payload))


def role_prompt(base: Column, extra: Column) -> Column:
    """The translator's role, and the user's own requirements below it where there are any."""
    more = T.strip(F.coalesce(extra, F.lit("")))
    return F.when(more == "", base).otherwise(F.concat(base, F.lit("\n\n## Requirements\n"), more))


def request_options(base_url: Column, model: Column) -> Column:
    """Options that a family of models needs, as JSON: those that think unless told not to."""
    thinks = F.contains(F.coalesce(base_url, F.lit("")), F.lit(THINKING[0])) | F.startswith(F.lower(F.coalesce(model, F.lit(""))), F.lit(THINKING[1]))
    return F.when(thinks, F.lit('{"enable_thinking":false}')).otherwise(F.lit("{}"))

"""Rows that the test tables have no counterpart for, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread

GLOSSARY = """SELECT * FROM (VALUES (0, 0, 'tion', '译项'), (0, 1, 'ing', '进行'), (1, 0, 'tion', '另一'), (1, 1, ' ble ', '可'), (1, 2, 'none', ' '), (2, 0, 'keep', 'the of')) AS g(file_no, row_no, source, target)"""
MARKED = """SELECT * FROM (VALUES (1, 'See {v1} and <style id=''2''>bold</style> <b3>x</b3>'), (2, 'spaced { v 4 } < style id = '' 5 '' > < / style >'), (3, 'none'), (4, 'twice {v1} {v1}'), (5, ''), (6, NULL), (7, 'wide { v٣ } 1 234')) AS m(id, text)"""
RANGES = """SELECT * FROM (VALUES (1, '1-3,7', 10), (2, '', 4), (3, ' 5- ', 8), (4, '-3', 8), (5, '2，4-4，9-20', 10), (6, '11-12', 10), (7, '3,3,1-2', 5)) AS r(id, spec, pages)"""
REPLIES = """SELECT * FROM (VALUES (1, '```json
[{"id": 2, "output": "b"}, {"id": "1", "output": "a"}, {"id": 2, "output": "c"}]
```'), (2, '{"id": 5, "input": "kept"}'), (3, '[{"id": 1, "output": 7, "input": "no"}, {"output": "no id"}, 3]'), (4, 'not json'), (5, '<json>[{"id": 9, "output": "x", "verdict": "FIXED", "problems": "one"}, {"id": 8, "problems": ["p", " ", "q"], "output": null}]</json>')) AS r(batch, reply)"""
PROMPTS = """SELECT * FROM (VALUES (1, '## Glossary Tables
| Source Term | Target Term |
|---|---|
| cell | 细胞 |
| DNA | DNA |

## Contextual Hints for Better Translation
Title: A
## Here is the input:
[]'), (2, 'Now translate the following text:  Hello there '), (3, 'no marker')) AS p(id, prompt)"""

SPECS = """SELECT * FROM (VALUES (1, '1-3,7', 4, 10, false), (2, '5-', 3, 8, false), (3, ' 5-, ', 8, 8, false), (4, '-3', NULL, 8, false), (5, '0-2', 2, 6, false), (6, '5-3', 6, 6, false), (7, 'x', 1, 4, false), (8, '11-12', 2, 10, false), (9, '', 3, 3, true), (10, '2，4-4，', 2, 5, false), (11, '', 0, 0, false)) AS r(id, spec, own, pages, encrypted)"""
MODELS = """SELECT * FROM (VALUES (1, 'https://dashscope.example/v1', 'other'), (2, 'https://api.example/v1', 'Qwen-plus'), (3, 'https://api.example/v1', 'model-x'), (4, NULL, NULL)) AS m(id, base_url, model)"""
BATCH_PROMPTS = """SELECT * FROM (VALUES (1, 'Rules
## Here is the input:
[{"id": 0, "input": "a {v1}", "layout_label": "text"}, {"id": 1, "input": "b"}, {"id": 1, "input": "c"}]'), (2, 'no marker [{"id": 0, "input": "a"}]'), (3, '## Here is the input: [{"id": 0, "input": "a"}, {"input": "b"}]'), (4, '## Here is the input: {"id": 0, "input": "a"}'), (5, '## Here is the input: not json'), (6, NULL), (7, '## Here is the input: [1]'), (8, '## Here is the input: [{"id": "x", "input": "odd"}, {"id": 4, "input": "d"}, {"id": null, "input": "none"}]')) AS p(batch, prompt)"""
PROGRESS = """SELECT * FROM (VALUES (1, '翻译（3/20），预计 5 分钟', 12.5, 20, 10, 50.0, 4, 8), (2, '排版', 2.0, 1, 10, 100.0, 0, 1), (3, '解析（1/2）', 0.0, 5, 3, 0.0, 7, 8)) AS g(id, line, pace, remaining, batch, percent, done, total)"""


def sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with drafts: in full, without digits, with the first line left as it was, and with one in ten empty."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.col("text").alias("source"))
    full = T.pseudo_translation(F.col("source"))
    first = F.substring_index("source", "\n", 1)
    rest = T.pseudo_translation(F.substring(F.col("source"), F.length(first) + 1, F.length("source")))
    return docs.select("doc_id", "source", full.alias("draft"), F.regexp_replace(full, "[0-9]+", "").alias("draft_nonum"), F.concat(first, rest).alias("draft_partial"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(full).alias("draft_empty"))


#: The same in DuckDB, as common table expressions to start a query with.
W = "[A-Za-z][A-Za-z''’-]*"
PAIRS = rf"""pairs AS (SELECT doc_id, text AS source, regexp_replace(text, '{W}', '译文', 'g') AS draft,
  regexp_replace(regexp_replace(text, '{W}', '译文', 'g'), '[0-9]+', '', 'g') AS draft_nonum,
  regexp_extract(text, '^[^\n]*') || regexp_replace(regexp_replace(text, '^[^\n]*', ''), '{W}', '译文', 'g') AS draft_partial,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE regexp_replace(text, '{W}', '译文', 'g') END AS draft_empty
  FROM documents)"""

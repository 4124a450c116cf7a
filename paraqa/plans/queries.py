"""One query for each operator, over the whole of its tables, and its equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, chunks, prompts, ranges
from ..functions import text as T
from ..operators import decisions, glossary, journal, layout, report, viewer
from ..sources import tables
from ..streaming import resume
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Pieces of DuckDB SQL. RE2 has no lookaround, and quotes are doubled in its literals.
P, SP, D = T.PLACEHOLDER.replace("'", "''"), T.SPACE, T.DIGIT


class Sql(str):
    """SQL with the places {0} and {1}; other braces are the patterns' own."""

    def format(self, *parts: str) -> str:
        out = str(self)
        for k, part in enumerate(parts):
            out = out.replace(f"{{{k}}}", part)
        return out


PLAIN = Sql("regexp_replace({0}, '" + P + "', ' ', 'g')")
STRIP = Sql("regexp_replace({0}, '^" + SP + "|" + SP + "$', '', 'g')")
SQUASH = Sql("regexp_replace(regexp_replace(regexp_replace({0}, '" + P + "', '', 'g'), '<[^>]+>', '', 'g'), '" + SP + "', '', 'g')")
NUMBERS = Sql("list_transform(regexp_extract_all(" + PLAIN + rf", '{D}+(?:[.,]{D}+)*'), lambda n: array_to_string(list_transform(string_split(n, ','), lambda p, i: CASE WHEN i = 1 OR regexp_matches(p, '^{D}{{3}}([.]|$)') THEN p ELSE ',' || p END), ''))")
RUNS = Sql("list_transform(regexp_extract_all(" + PLAIN + ", '(?:" + X.W + f"[{T.SPACES},;:]+)" + "{{1},}" + X.W + "'), lambda r: " + STRIP.format("r") + ")")
WORDS = Sql("len(regexp_extract_all(" + PLAIN + ", '[A-Za-z][A-Za-z''’-]+'))")
CJK = Sql(r"len(regexp_extract_all({0}, '[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]'))")
SURPLUS = Sql("list_sort(list_filter(list_distinct({0}), lambda x: len(list_filter({0}, lambda y: y = x)) > len(list_filter({1}, lambda y: y = x))))")
TIGHT = Sql("length(regexp_replace(" + PLAIN + ", '" + SP + "', '', 'g'))")
CLEAN = Sql(STRIP.format("regexp_replace(" + STRIP.format("regexp_replace(" + STRIP.format("{0}") + ", '^<json>|</json>$', '', 'g')") + r", '^```(?:json)?\s*|\s*```$', '', 'g')"))


def runs_sql(column: str, least: int) -> str:
    return RUNS.format(column, str(least - 1))


def issues_sql(source: str, output: str, keep: str = "[]::VARCHAR[]") -> str:
    """The rules as one expression: a joined list of codes."""
    s, o = STRIP.format(source), STRIP.format(f"coalesce({output}, '')")
    num = SURPLUS.format(NUMBERS.format(s), NUMBERS.format(o))
    holders = lambda c: rf"list_sort(list_transform(regexp_extract_all({c}, '{P}'), lambda p: regexp_replace(p, '{SP}', '', 'g')))"
    left = f"list_filter({runs_sql(o, 4)}, lambda r: contains(lower({s}), lower(r)) AND NOT list_contains({keep}, lower(r)))"
    prose, cjk = f"{WORDS.format(s)} >= 4", CJK.format(o)
    long_enough, ratio = f"{TIGHT.format(s)} >= 40", f"{TIGHT.format(o)}::DOUBLE / greatest({TIGHT.format(s)}, 1)"
    return f"""CASE WHEN {o} = '' THEN 'empty' ELSE array_to_string(list_filter([
      CASE WHEN {holders(s)} <> {holders(o)} THEN 'markup' END,
      CASE WHEN len({num}) > 0 THEN 'numbers:' || array_to_string({num}, '|') END,
      CASE WHEN {prose} AND len({left}) > 0 THEN 'leftover:' || array_to_string({left}[1:3], '|') END,
      CASE WHEN {prose} AND {cjk} = 0 THEN 'no_cjk' END,
      CASE WHEN {prose} AND {cjk} > 0 AND {long_enough} AND {ratio} < 0.18 THEN 'short' END,
      CASE WHEN {prose} AND {cjk} > 0 AND {long_enough} AND {ratio} > 1.3 THEN 'long' END], lambda x: x IS NOT NULL), ',') END"""


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for queries that work on their texts."""
    return tables.spread(_table(spark, sf_dir, "documents"))


def _joined(c: str):
    return F.array_join(c, ",")


# --- text functions


@query("placeholders", rf"SELECT id, array_to_string(list_transform(regexp_extract_all(text, '{P}'), lambda p: regexp_replace(p, '{SP}', '', 'g')), ',') AS found, {PLAIN.format('text')} AS plain FROM ({X.MARKED})")
def placeholders(spark, sf_dir):
    return X.sql(spark, X.MARKED).select("id", F.array_join(T.placeholders(F.col("text")), ",").alias("found"), T.plain(F.col("text")).alias("plain"))


@query("numbers_norm", f"SELECT doc_id, array_to_string({NUMBERS.format('text')}, '|') AS numbers FROM documents")
def numbers_norm(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.array_join(T.numbers(F.col("text")), "|").alias("numbers"))


@query("english_runs", f"SELECT doc_id, len(r) AS n_runs, coalesce(list_max(list_transform(r, lambda x: length(x))), 0)::INT AS longest FROM (SELECT doc_id, {runs_sql('text', 4)} AS r FROM documents)")
def english_runs(spark, sf_dir):
    runs = _texts(spark, sf_dir).select("doc_id", T.english_runs(F.col("text")).alias("r"))
    return runs.select("doc_id", F.size("r").cast("long").alias("n_runs"), F.coalesce(F.array_max(F.transform("r", F.length)), F.lit(0)).alias("longest"))


@query("cjk_ratio", f"WITH {X.PAIRS} SELECT doc_id, {CJK.format('draft')} AS cjk, {TIGHT.format('draft')} AS chars FROM pairs")
def cjk_ratio(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("doc_id", T.count_cjk(F.col("draft")).cast("long").alias("cjk"), F.length(T.without_space(T.plain(F.col("draft")))).cast("long").alias("chars"))


@query("squash", f"SELECT page_id, {SQUASH.format('html')} AS squashed FROM pages")
def squash(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.squash(F.col("html")).alias("squashed"))


@query("text_key", f"SELECT doc_id, sha256({STRIP.format('text')}) AS k FROM documents")
def text_key(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.key(F.col("text")).alias("k"))


@query("job_signature", """SELECT doc_id, sha256('{"c0":' || doc_id || ',"c1":"' || lang || '","c2":"' || source || '","c3":"full"}') AS signature FROM documents""")
def job_signature(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", resume.signature(F.col("doc_id"), F.col("lang"), F.col("source"), F.lit("full")).alias("signature"))


@query("clean_json", f"SELECT batch, {CLEAN.format('reply')} AS reply FROM ({X.REPLIES})")
def clean_json(spark, sf_dir):
    return X.sql(spark, X.REPLIES).select("batch", prompts.clean_json(F.col("reply")).alias("reply"))


def _section_sql(heading: str) -> str:
    return STRIP.format(rf"regexp_extract(prompt, '(?ms)^## {heading}\s*$(.*?)(?:^## |\z)', 1)")


def _tail_sql(marker: str) -> str:
    return f"CASE WHEN contains(prompt, '{marker}') THEN {STRIP.format(f"substr(prompt, instr(prompt, '{marker}') + {len(marker)})")} END"


@query("prompt_section", f"SELECT id, {_section_sql(prompts.GLOSSARY)} AS glossary, {_section_sql(prompts.HINTS)} AS context, {_tail_sql(T.SINGLE_MARKER)} AS single FROM ({X.PROMPTS})")
def prompt_section(spark, sf_dir):
    p = F.col("prompt")
    return X.sql(spark, X.PROMPTS).select("id", prompts.section(p, prompts.GLOSSARY).alias("glossary"), prompts.section(p, prompts.HINTS).alias("context"), prompts.tail(p).alias("single"))


@query(
    "glossary_targets",
    f"""WITH r AS (SELECT id, list_transform(string_split(g, chr(10)), lambda l: list_transform(string_split(trim({STRIP.format("l")}, '|'), '|'), lambda c: {STRIP.format("c")})) AS cells FROM (SELECT id, {_section_sql(prompts.GLOSSARY)} AS g FROM ({X.PROMPTS})))
    SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_filter(cells, lambda c: len(c) = 2 AND c[1] NOT IN ('', 'Source Term') AND NOT regexp_full_match(c[1], '[-: ]+')), lambda c: c[2]))), ',') AS terms FROM r""",
)
def glossary_targets(spark, sf_dir):
    targets = prompts.glossary_targets(prompts.section(F.col("prompt"), prompts.GLOSSARY))
    return X.sql(spark, X.PROMPTS).select("id", F.array_join(F.array_sort(targets), ",").alias("terms"))


@query(
    "parse_batch_prompt",
    f"""WITH j AS (SELECT batch, try_cast({_tail_sql(T.BATCH_MARKER)} AS JSON) AS j FROM ({X.BATCH_PROMPTS})),
    l AS (SELECT batch, from_json(j, '["JSON"]') AS items FROM j WHERE json_type(j) = 'ARRAY'),
    g AS (SELECT batch, items FROM l WHERE len(list_filter(items, lambda x: json_type(x) = 'OBJECT' AND list_contains(json_keys(x), 'id'))) = len(items)),
    e AS (SELECT batch, i, try_cast(json_extract_string(items[i], '$.id') AS INT) AS id, json_extract_string(items[i], '$.input') AS input FROM g, unnest(range(1, len(items) + 1)) AS t(i))
    SELECT batch, id, arg_max(input, i) AS input FROM e GROUP BY batch, id, CASE WHEN id IS NULL THEN i END""",
)
def parse_batch_prompt(spark, sf_dir):
    return prompts.batch_prompt(X.sql(spark, X.BATCH_PROMPTS), "batch", "prompt")


@query("role_prompt", f"SELECT conv_id, turn, md5('role' || CASE WHEN turn % 2 = 1 AND {STRIP.format('text')} <> '' THEN chr(10) || chr(10) || '## Requirements' || chr(10) || {STRIP.format('text')} ELSE '' END) AS prompt FROM conversations")
def role_prompt(spark, sf_dir):
    extra = F.when(F.col("turn") % 2 == 1, F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(prompts.role_prompt(F.lit("role"), extra)).alias("prompt"))


@query("request_options", f"""SELECT id, CASE WHEN base_url LIKE '%dashscope%' OR lower(model) LIKE 'qwen%' THEN '{{"enable_thinking":false}}' ELSE '{{}}' END AS options FROM ({X.MODELS})""")
def request_options(spark, sf_dir):
    return X.sql(spark, X.MODELS).select("id", prompts.request_options(F.col("base_url"), F.col("model")).alias("options"))


@query("review_prompt", """SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '## Context' || chr(10) || 'c' || conv_id || chr(10) || chr(10) ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN '## Glossary' || chr(10) || 'g' || chr(10) || chr(10) ELSE '' END || '## Rows' || chr(10) || '[' || string_agg('{"id":' || turn || ',"output":"' || role || '"}', ',' ORDER BY turn) || ']' AS prompt FROM conversations GROUP BY conv_id""")
def review_prompt(spark, sf_dir):
    replies = prompts.dump_output(_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("role").alias("output")), "conv_id")
    c = F.col("conv_id")
    return replies.select("conv_id", prompts.review_prompt(F.col("reply"), F.when(c % 3 == 0, "g"), F.when(c % 2 == 0, F.concat(F.lit("c"), c))).alias("prompt"))


@query("progress", rf"SELECT id, regexp_replace(regexp_replace(line, '（\d+/\d+）', ''), '，?\s*预计.*$', '') AS line, greatest(0.0, pace::DOUBLE * (remaining - batch * percent::DOUBLE / 100)) / 60 AS eta, (done + percent::DOUBLE / 100) / total * 100 AS overall FROM ({X.PROGRESS})")
def progress(spark, sf_dir):
    number = lambda c: F.col(c).cast("double")
    eta = T.eta_minutes(number("pace"), number("remaining"), number("batch"), number("percent"))
    return X.sql(spark, X.PROGRESS).select("id", T.progress_text(F.col("line")).alias("line"), eta.alias("eta"), T.overall_progress(number("done"), number("percent"), number("total")).alias("overall"))


_REPLY_ITEMS = f"""j AS (SELECT batch, try_cast({CLEAN.format('reply')} AS JSON) AS j FROM ({X.REPLIES})),
    l AS (SELECT batch, CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') ELSE [j] END AS items FROM j WHERE j IS NOT NULL),
    e AS (SELECT batch, i, items[i] AS x, try_cast(json_extract_string(items[i], '$.id') AS INT) AS id FROM l, unnest(range(1, len(items) + 1)) AS t(i) WHERE json_type(items[i]) = 'OBJECT')"""


@query(
    "parse_batch_output",
    f"""WITH {_REPLY_ITEMS}, v AS (SELECT batch, id, i, CASE WHEN list_contains(json_keys(x), 'output') THEN json_extract(x, '$.output') ELSE json_extract(x, '$.input') END AS v FROM e WHERE id IS NOT NULL)
    SELECT batch, id, arg_max(json_extract_string(v, '$'), i) AS output FROM v WHERE json_type(v) = 'VARCHAR' GROUP BY batch, id""",
)
def parse_batch_output(spark, sf_dir):
    return prompts.batch_output(X.sql(spark, X.REPLIES), "batch", "reply")


@query(
    "parse_review",
    f"""WITH {_REPLY_ITEMS}, r AS (SELECT batch, id, i, lower(coalesce(json_extract_string(x, '$.verdict'), 'ok')) AS verdict,
      CASE json_type(x, '$.problems') WHEN 'VARCHAR' THEN [json_extract_string(x, '$.problems')] WHEN 'ARRAY' THEN from_json(json_extract(x, '$.problems'), '["VARCHAR"]') ELSE [] END AS problems,
      CASE WHEN json_type(x, '$.output') = 'VARCHAR' THEN json_extract_string(x, '$.output') ELSE '' END AS output FROM e WHERE id IS NOT NULL)
    SELECT batch, id, arg_max(verdict, i) AS verdict, array_to_string(arg_max(list_filter(problems, lambda p: {STRIP.format('p')} <> ''), i), ',') AS problems, arg_max(output, i) AS output FROM r GROUP BY batch, id""",
)
def parse_review(spark, sf_dir):
    return prompts.reviews(X.sql(spark, X.REPLIES), "batch", "reply").withColumn("problems", _joined("problems"))


@query("dump_batch_output", """SELECT conv_id, '[' || string_agg('{"id":' || turn || ',"output":"' || role || '"}', ',' ORDER BY turn) || ']' AS reply FROM conversations GROUP BY conv_id""")
def dump_batch_output(spark, sf_dir):
    return prompts.dump_output(_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("role").alias("output")), "conv_id")


@query(
    "split_text",
    r"""WITH RECURSIVE s AS (
      SELECT doc_id, text, string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
    u AS (SELECT doc_id, text, flatten(list_transform(parts, lambda p: CASE WHEN length(p) <= 200 THEN [{'t': p, 'cut': false}]
      ELSE list_transform(range(0, (length(p) - 1) // 200 + 1), lambda k: {'t': substr(p, k * 200 + 1, 200), 'cut': k < (length(p) - 1) // 200}) END)) AS units FROM s),
    f AS (SELECT doc_id, text, list_reduce(list_transform(units, lambda x: {'p': []::VARCHAR[], 'c': x.t, 'cut': x.cut}), lambda a, x: CASE
        WHEN x.cut THEN {'p': a.p || CASE WHEN a.c = '' THEN []::VARCHAR[] ELSE [a.c] END || [x.c], 'c': '', 'cut': false}
        WHEN a.c = '' THEN {'p': a.p, 'c': x.c, 'cut': false}
        WHEN length(a.c) + 1 + length(x.c) > 200 THEN {'p': a.p || [a.c], 'c': x.c, 'cut': false}
        ELSE {'p': a.p, 'c': a.c || ' ' || x.c, 'cut': false} END, {'p': []::VARCHAR[], 'c': '', 'cut': false}) AS r FROM u)
    SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, '|')) AS pieces FROM (
      SELECT doc_id, CASE WHEN length(text) <= 200 THEN [text] ELSE r.p || CASE WHEN r.c = '' THEN []::VARCHAR[] ELSE [r.c] END END AS p FROM f)""",
)
def split_text(spark, sf_dir):
    pieces = _texts(spark, sf_dir).select("doc_id", chunks.split_text("text", 200).alias("p"))
    return pieces.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("pieces"))


@query("join_pieces", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS tight, md5(string_agg(text, ' ' ORDER BY turn)) AS spaced FROM conversations GROUP BY conv_id")
def join_pieces(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    pieces = F.transform("t", lambda x: x.text)
    return turns.select("conv_id", F.md5(chunks.join_pieces(pieces)).alias("tight"), F.md5(chunks.join_pieces(pieces, spaced=True)).alias("spaced"))


# --- checks


@query("check_issues", f"WITH {X.PAIRS} SELECT doc_id, {issues_sql('source', 'draft_nonum')} AS nonum, {issues_sql('source', 'draft_empty')} AS emptied FROM pairs")
def check_issues(spark, sf_dir):
    issue = lambda c: F.array_join(checks.check(F.col("source"), F.col(c)), ",")
    return X.pairs(spark, sf_dir).select("doc_id", issue("draft_nonum").alias("nonum"), issue("draft_empty").alias("emptied"))


@query("issue_counts", f"WITH {X.PAIRS}, i AS (SELECT unnest(string_split(issues, ',')) AS issue FROM (SELECT {issues_sql('source', 'draft_nonum')} AS issues FROM pairs)) SELECT split_part(issue, ':', 1) AS code, count(*) AS n FROM i WHERE issue <> '' GROUP BY 1")
def issue_counts(spark, sf_dir):
    found = checks.checked(X.pairs(spark, sf_dir), "draft_nonum").select(F.explode("issues").alias("issue"))
    return found.groupBy(F.substring_index("issue", ":", 1).alias("code")).agg(F.count("*").alias("n"))


@query("missing_numbers", f"WITH {X.PAIRS} SELECT doc_id, array_to_string({SURPLUS.format(NUMBERS.format('source'), NUMBERS.format('draft_nonum'))}, '|') AS missing FROM pairs")
def missing_numbers(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("doc_id", F.array_join(T.surplus(T.numbers(F.col("source")), T.numbers(F.col("draft_nonum"))), "|").alias("missing"))


@query("leftover_english", f"WITH {X.PAIRS} SELECT doc_id, {issues_sql('source', 'draft_partial')} AS issues FROM pairs")
def leftover_english(spark, sf_dir):
    return checks.checked(X.pairs(spark, sf_dir), "draft_partial").select("doc_id", _joined("issues").alias("issues"))


@query("glossary_keep", f"WITH {X.PAIRS}, k AS (SELECT ['the of', 'in the of a'] AS keep) SELECT doc_id, {issues_sql('source', 'draft_partial', 'keep')} AS issues FROM pairs, k")
def glossary_keep(spark, sf_dir):
    keep = F.array(F.lit("the of"), F.lit("in the of a"))
    return checks.checked(X.pairs(spark, sf_dir), "draft_partial", keep).select("doc_id", _joined("issues").alias("issues"))


# --- decisions


_REVIEWED = f"""WITH {X.PAIRS}, r AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 'fixed' ELSE 'ok' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN draft_empty ELSE draft END AS output FROM pairs),
c AS (SELECT *, {issues_sql('source', 'output')} AS fi, {issues_sql('source', 'draft_nonum')} AS di FROM r),
n AS (SELECT *, verdict = 'fixed' AND {STRIP.format('output')} <> '' AS offered, (fi || ',') LIKE 'markup,%' AND NOT (di || ',') LIKE 'markup,%' AS breaks,
  len(string_split(nullif(fi, ''), ',')) AS fn, len(string_split(nullif(di, ''), ',')) AS dn FROM c)"""


@query("choose_final", _REVIEWED + f" SELECT doc_id, md5(CASE WHEN offered AND NOT breaks AND coalesce(fn, 0) <= coalesce(dn, 0) THEN {STRIP.format('output')} ELSE draft_nonum END) AS final, CASE WHEN offered AND breaks THEN 'kept_draft:markup' WHEN offered AND coalesce(fn, 0) > coalesce(dn, 0) THEN 'kept_draft:issues' ELSE '' END AS problems FROM n")
def choose_final(spark, sf_dir):
    rows = X.pairs(spark, sf_dir).withColumns({"output": F.when(F.col("doc_id") % 3 == 0, F.col("draft_empty")).otherwise(F.col("draft")), "verdict": F.when(F.col("doc_id") % 2 == 1, "fixed").otherwise("ok"), "problems": F.lit(None).cast("array<string>")})
    chosen = decisions.choose(rows.select("doc_id", "source", F.col("draft_nonum").alias("draft"), "output", "verdict", "problems"))
    return chosen.select("doc_id", F.md5("final").alias("final"), _joined("problems").alias("problems"))


@query("retranslate_accept", f"WITH {X.PAIRS}, c AS (SELECT *, {issues_sql('source', 'draft_empty')} AS a, {issues_sql('source', 'draft')} AS b FROM pairs) SELECT doc_id, md5(CASE WHEN better THEN draft ELSE draft_empty END) AS final, CASE WHEN better THEN a ELSE '' END AS problems FROM (SELECT *, a <> '' AND coalesce(len(string_split(nullif(b, ''), ',')), 0) < len(string_split(nullif(a, ''), ',')) AS better FROM c)")
def retranslate_accept(spark, sf_dir):
    rows = X.pairs(spark, sf_dir).select("doc_id", "source", F.col("draft_empty").alias("draft"), F.col("draft").alias("again"))
    return decisions.retranslated(rows).select("doc_id", F.md5("final").alias("final"), _joined("problems").alias("problems"))


_IMPROVE = f"""WITH {X.PAIRS}, r AS (SELECT *, doc_id % 10 AS batch, doc_id % 10 <> 7 AS read, doc_id % 10 <> 7 AND doc_id % 4 <> 0 AS named, CASE WHEN doc_id % 2 = 1 THEN 'fixed' ELSE 'ok' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN draft_empty ELSE draft END AS output FROM pairs),
c AS (SELECT *, string_split(nullif({issues_sql('source', 'output')}, ''), ',') AS fi, string_split(nullif({issues_sql('source', 'draft_nonum')}, ''), ',') AS di, string_split(nullif({issues_sql('source', 'draft')}, ''), ',') AS ai FROM r),
n AS (SELECT *, named AND verdict = 'fixed' AND {STRIP.format('output')} <> '' AS offered, coalesce(fi[1] = 'markup', false) AND NOT coalesce(di[1] = 'markup', false) AS breaks, coalesce(len(fi), 0) > coalesce(len(di), 0) AS worse, coalesce(len(ai), 0) < coalesce(len(di), 0) AS better FROM c),"""
_REVIEW_SQL = " CASE WHEN offered AND NOT breaks AND NOT worse THEN " + STRIP.format("output") + " ELSE draft_nonum END"
_AGAIN_SQL = " CASE WHEN better THEN draft ELSE draft_nonum END"
_SAID_SQL = "CASE WHEN named THEN 'p' || CASE WHEN offered AND breaks THEN ',kept_draft:markup' WHEN offered AND worse THEN ',kept_draft:issues' ELSE '' END ELSE '' END"
_OLD_SQL = "CASE WHEN better THEN array_to_string(di, ',') ELSE '' END"


def _improved(spark, sf_dir, mode: str) -> DataFrame:
    """Ten batches; the review of one can't be read, and those of the others leave out every fourth row."""
    pairs = X.pairs(spark, sf_dir).withColumn("batch", F.col("doc_id") % 10)
    rows = pairs.select("batch", F.col("doc_id").alias("id"), "source", F.col("draft_nonum").alias("draft"), F.col("draft").alias("again"))
    said = pairs.where("batch <> 7 AND doc_id % 4 <> 0").select("batch", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 1, "fixed").otherwise("ok").alias("verdict"), F.array(F.lit("p")).alias("problems"), F.when(F.col("doc_id") % 3 == 0, F.col("draft_empty")).otherwise(F.col("draft")).alias("output"))
    return decisions.improve(rows, mode, said, pairs.select("batch").distinct().where("batch <> 7"))


def _shown(improved: DataFrame) -> DataFrame:
    return improved.select(F.col("id").alias("doc_id"), F.md5("final").alias("final"), _joined("problems").alias("problems"))


@query("improve_full", _IMPROVE + f" o AS (SELECT doc_id, CASE WHEN read THEN {_REVIEW_SQL} ELSE {_AGAIN_SQL} END AS final, CASE WHEN read THEN {_SAID_SQL} ELSE {_OLD_SQL} END AS problems FROM n) SELECT doc_id, md5(final) AS final, problems FROM o")
def improve_full(spark, sf_dir):
    return _shown(_improved(spark, sf_dir, "full"))


@query("improve_rules", _IMPROVE + f" o AS (SELECT doc_id, {_AGAIN_SQL} AS final, {_OLD_SQL} AS problems FROM n) SELECT doc_id, md5(final) AS final, problems FROM o")
def improve_rules(spark, sf_dir):
    return _shown(_improved(spark, sf_dir, "rules"))


@query("improve_off", f"WITH {X.PAIRS} SELECT doc_id, md5(draft_nonum) AS final, '' AS problems FROM pairs")
def improve_off(spark, sf_dir):
    return _shown(_improved(spark, sf_dir, "off"))


@query("improve_notes", _IMPROVE + f" o AS (SELECT doc_id, sha256({STRIP.format('source')}) AS k, draft_nonum AS d, {_AGAIN_SQL} AS f, {_OLD_SQL} AS p FROM n) SELECT k, md5(arg_max(d, doc_id)) AS draft, md5(arg_max(f, doc_id)) AS final, arg_max(p, doc_id) AS problems FROM o GROUP BY k")
def improve_notes(spark, sf_dir):
    improved = _improved(spark, sf_dir, "rules")
    notes = journal.latest(decisions.notes_of(improved, F.col("id")), "k")
    return notes.select("k", F.md5("draft").alias("draft"), F.md5("final").alias("final"), _joined("problems").alias("problems"))


@query("min_text_length", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) >= 3 GROUP BY doc_id")
def min_text_length(spark, sf_dir):
    lines = tables.blocks(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")).withColumnRenamed("text", "source")
    return decisions.translatable(lines).groupBy(F.col("page").alias("doc_id")).agg(F.count("*").alias("n"))


def _overrides(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where("doc_id % 7 = 0")
    return rows.groupBy(T.key(F.col("text")).alias("k")).agg(F.max(F.concat(F.lit("手动"), F.col("doc_id"))).alias("translation"))


def _notes(spark, sf_dir) -> DataFrame:
    """Translated after sources with one key became one row."""
    rows = X.pairs(spark, sf_dir).where("doc_id % 2 = 0").groupBy(T.key(F.col("source")).alias("k")).agg(F.min("doc_id").alias("d"), F.min_by("source", "doc_id").alias("source"))
    rows = rows.withColumn("final", T.pseudo_translation(F.col("source")))
    return rows.select("k", F.regexp_replace("final", "[0-9]+", "").alias("draft"), "final", F.array(F.concat(F.lit("p"), F.col("d"))).alias("problems"))


_FINISH = f"""WITH {X.PAIRS}, o AS (SELECT sha256({STRIP.format('text')}) AS k, max('手动' || doc_id) AS translation FROM documents WHERE doc_id % 7 = 0 GROUP BY 1),
n AS (SELECT sha256({STRIP.format('source')}) AS k, arg_min(draft_nonum, doc_id) AS ndraft, arg_min(draft, doc_id) AS nfinal, 'p' || min(doc_id) AS problem FROM pairs WHERE doc_id % 2 = 0 GROUP BY 1),
j AS (SELECT p.doc_id, p.source, p.draft_partial, o.translation, n.ndraft, n.nfinal, n.problem FROM (SELECT *, sha256({STRIP.format('source')}) AS k FROM pairs) p LEFT JOIN o USING (k) LEFT JOIN n USING (k)),
f AS (SELECT doc_id AS seq, source, translation IS NOT NULL AS overridden, coalesce(translation, draft_partial) AS final, coalesce(ndraft, '') AS draft, coalesce(problem, '') AS problems,
  coalesce(ndraft, '') <> '' AND {STRIP.format("coalesce(ndraft, '')")} <> {STRIP.format("coalesce(nfinal, '')")} AS corrected,
  CASE WHEN translation IS NOT NULL THEN '' ELSE {issues_sql('source', 'draft_partial')} END AS issues FROM j)"""


def _paragraphs(spark, sf_dir) -> DataFrame:
    rows = X.pairs(spark, sf_dir).select(F.col("doc_id").alias("seq"), "source", F.col("draft_partial").alias("text"))
    return decisions.finish(rows, _overrides(spark, sf_dir), _notes(spark, sf_dir))


@query("override_overlay", _FINISH + " SELECT seq, overridden, md5(final) AS final FROM f")
def override_overlay(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("seq", "overridden", F.md5("final").alias("final"))


@query("note_overlay", _FINISH + " SELECT seq, md5(draft) AS draft, problems, corrected, issues FROM f")
def note_overlay(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("seq", F.md5("draft").alias("draft"), _joined("problems").alias("problems"), "corrected", _joined("issues").alias("issues"))


@query("override_short_circuit", f"SELECT doc_id FROM documents WHERE sha256({STRIP.format('text')}) NOT IN (SELECT sha256({STRIP.format('text')}) FROM documents WHERE doc_id % 7 = 0)")
def override_short_circuit(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    return decisions.needing_translation(rows, _overrides(spark, sf_dir)).select("doc_id")


@query("draft_join", f"WITH {X.PAIRS} SELECT s.doc_id, md5(d.draft) AS draft FROM documents s JOIN pairs d USING (doc_id) WHERE s.doc_id % 2 = 0 OR s.lang = 'en'")
def draft_join(spark, sf_dir):
    sources = _table(spark, sf_dir, "documents").where("doc_id % 2 = 0 OR lang = 'en'").select("doc_id")
    return decisions.drafts_with_sources(sources, X.pairs(spark, sf_dir).select("doc_id", "draft"), "doc_id").select("doc_id", F.md5("draft").alias("draft"))


# --- journal and store


@query("journal_last_write", "SELECT role AS source, min(conv_id * 1000 + turn) AS first_seq, arg_max(conv_id, conv_id * 1000 + turn) AS conv_id, arg_max(turn, conv_id * 1000 + turn) AS turn FROM conversations GROUP BY role UNION ALL SELECT text, min(conv_id * 1000 + turn), arg_max(conv_id, conv_id * 1000 + turn), arg_max(turn, conv_id * 1000 + turn) FROM conversations GROUP BY text")
def journal_last_write(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    by = lambda c: journal.latest(rows.select(F.col(c).alias("source"), "seq", "conv_id", "turn"), "source")
    return by("role").union(by("text"))


def _keyed(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    return rows.groupBy(T.key(F.col("text")).alias("k")).agg(F.max("doc_id").alias("final"))


@query("upsert_notes", f"WITH a AS (SELECT sha256({STRIP.format('text')}) AS k, max(doc_id) AS final FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT sha256({STRIP.format('text')}) AS k, max(doc_id) + 1000000 AS final FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT k, coalesce(b.final, a.final) AS final FROM a FULL JOIN b USING (k)")
def upsert_notes(spark, sf_dir):
    changes = _table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(T.key(F.col("text")).alias("k"), (F.col("doc_id") + 1000000).alias("final"), F.col("doc_id").alias("seq"))
    return journal.upsert(_keyed(spark, sf_dir), changes)


@query("delete_override", f"SELECT sha256({STRIP.format('text')}) AS k, max(doc_id) AS final FROM documents WHERE doc_id % 2 = 0 AND sha256({STRIP.format('text')}) NOT IN (SELECT sha256({STRIP.format('text')}) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def delete_override(spark, sf_dir):
    return journal.delete(_keyed(spark, sf_dir), journal.with_key(_table(spark, sf_dir, "documents").where("doc_id % 3 = 0").drop("source").withColumnRenamed("text", "source")))


@query("batch_new_sources", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def batch_new_sources(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    return journal.new_sources(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0")).select("doc_id")


# --- report


_FIND = """probes AS (SELECT item, unnest([{'n': 0, 'p': substr(s, 1, 12)}, {'n': 1, 'p': substr(s, length(s) // 2 + 1, 12)}]) AS q FROM (SELECT item, %s AS s FROM items)),
found AS (SELECT item, arg_min(page, (q.n, page)) AS page FROM probes JOIN (SELECT page, %s AS s FROM pg) pg ON length(q.p) >= 4 AND contains(pg.s, q.p) GROUP BY item)""" % (SQUASH.format("text"), SQUASH.format("text"))


@query("page_finder", f"WITH items AS (SELECT item_id AS item, text FROM benchmark), pg AS (SELECT doc_id AS page, text FROM documents), {_FIND} SELECT * FROM found")
def page_finder(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    return report.find_pages(items, _texts(spark, sf_dir).select(F.col("doc_id").alias("page"), "text"))


_BLOCKS = f"""blocks AS (SELECT doc_id AS page, doc_id * 100000 + i - 1 AS block_no, {STRIP.format('l[i]')} AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)),
english AS (SELECT page, block_no, regexp_replace(text, '{SP}', ' ', 'g') AS text FROM blocks WHERE len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]+')) >= 12 AND {CJK.format('text')} < 0.1 * length(text) AND len({runs_sql('text', 6)}) > 0)"""


def _blocks(spark, sf_dir) -> DataFrame:
    lines = tables.blocks(_texts(spark, sf_dir).select(F.col("doc_id").alias("page"), "text"))
    return lines.select("page", (F.col("page") * 100000 + F.col("i")).alias("block_no"), "text")


@query("english_blocks", f"WITH {_BLOCKS} SELECT page, block_no, md5(text) AS text FROM english")
def english_blocks(spark, sf_dir):
    return report.english_blocks(_blocks(spark, sf_dir)).select("page", "block_no", F.md5("text").alias("text"))


_START = f"substr({SQUASH.format('text')}, 1, 40)"


@query("english_unreported", f"WITH {_BLOCKS} SELECT page, block_no, md5(text) AS text FROM english WHERE {_START} NOT IN (SELECT {_START} FROM documents WHERE lang = 'en')")
def english_unreported(spark, sf_dir):
    paragraphs = _table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("text").alias("source"))
    return report.unreported(report.english_blocks(_blocks(spark, sf_dir)), paragraphs).select("page", "block_no", F.md5("text").alias("text"))


_ITEMS = (
    _FINISH
    + f""", k AS (SELECT *, CASE WHEN overridden THEN 'manual' WHEN issues <> '' THEN 'check' WHEN corrected THEN 'fixed' END AS kind FROM f),
items AS (SELECT seq AS item, final AS text FROM k WHERE kind IS NOT NULL), pg AS (SELECT doc_id AS page, draft AS text FROM pairs), {_FIND},
{_BLOCKS},
report AS (SELECT seq, kind, page, md5(source) AS source FROM k LEFT JOIN found ON seq = item WHERE kind IS NOT NULL
  UNION ALL SELECT block_no, 'english', page, md5(text) FROM english WHERE {_START} NOT IN (SELECT substr({SQUASH.format('source')}, 1, 40) FROM pairs))"""
)


def _items(spark, sf_dir, *shown) -> DataFrame:
    drafts = X.pairs(spark, sf_dir).select(F.col("doc_id").alias("page"), F.col("draft").alias("text"))
    return report.build(_paragraphs(spark, sf_dir), drafts, _blocks(spark, sf_dir), shown)


@query("report_items", _ITEMS + " SELECT * FROM report ORDER BY list_position(['check', 'english', 'fixed', 'manual'], kind), coalesce(page, 1000000), seq")
def report_items(spark, sf_dir):
    return _items(spark, sf_dir, F.md5("source").alias("source")).select("seq", "kind", "page", "source")


@query("report_summary", _ITEMS + ' SELECT count(*) FILTER (kind = \'check\') AS "check", count(*) FILTER (kind = \'english\') AS english, count(*) FILTER (kind = \'fixed\') AS fixed, count(*) FILTER (kind = \'manual\') AS manual, (SELECT count(*) FROM pairs) AS paragraphs FROM report')
def report_summary(spark, sf_dir):
    return report.summary(_paragraphs(spark, sf_dir), _blocks(spark, sf_dir))


@query("report_filter_kind", _ITEMS + " SELECT * FROM report WHERE kind = 'english'")
def report_filter_kind(spark, sf_dir):
    sources = X.pairs(spark, sf_dir).select("source")
    return report.english_items(sources, _blocks(spark, sf_dir)).select("seq", "kind", "page", F.md5("source").alias("source"))


@query("report_snippets", _ITEMS.replace("lambda x: x IS NOT NULL), ',')", "lambda x: x IS NOT NULL), '; ')").replace("md5(source) AS source FROM k LEFT", "source, final, issues, problems, corrected FROM k LEFT").replace("md5(text) FROM english", "text, '', '', '', false FROM english") + """
  SELECT seq, kind, md5(CASE WHEN kind = 'manual' THEN 'manual' WHEN kind = 'english' THEN 'english' WHEN issues <> '' THEN issues || CASE WHEN problems <> '' THEN '; review:' || problems ELSE '' END WHEN problems <> '' THEN problems ELSE 'corrected' END
    || ' | ' || substr(CASE WHEN final <> '' THEN final ELSE source END, 1, 80)) AS snippet FROM report""")
def report_snippets(spark, sf_dir):
    return _items(spark, sf_dir, F.md5(report.snippet()).alias("snippet")).select("seq", "kind", "snippet")


@query("block_scan", "SELECT page_id AS page, i - 1 AS i, md5(l[i]) AS text FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages), unnest(range(1, len(l) + 1)) AS t(i)")
def block_scan(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("text"))
    return tables.blocks(pages).select("page", F.col("i").cast("long").alias("i"), F.md5("text").alias("text"))


# --- ranges, glossary


def _pages_sql(spec: str) -> str:
    """Pages of a range, null where it is wrong."""
    part = f"list_filter(list_transform(string_split(replace({STRIP.format(spec)}, '，', ','), ','), lambda p: {STRIP.format('p')}), lambda p: p <> '')"
    ends = f"""list_transform({part}, lambda p: CASE WHEN contains(p, '-') THEN {{'a': CASE WHEN trim(split_part(p, '-', 1)) = '' THEN 1 ELSE try_cast(trim(split_part(p, '-', 1)) AS INT) END, 'z': CASE WHEN trim(split_part(p, '-', 2)) = '' THEN pages ELSE try_cast(trim(split_part(p, '-', 2)) AS INT) END}}
      ELSE {{'a': try_cast(p AS INT), 'z': try_cast(p AS INT)}} END)"""
    some = f"list_sort(list_distinct(flatten(list_transform({ends}, lambda r: range(r.a - 1, least(r.z, pages))))))"
    good = f"len(list_filter({ends}, lambda r: r.a >= 1 AND r.z >= r.a)) = len({ends})"
    return f"CASE WHEN {STRIP.format(spec)} = '' THEN range(0, pages) WHEN {good} THEN {some} END"


@query("page_range_parse", f"SELECT id, array_to_string({_pages_sql('spec')}, ',') AS found FROM ({X.RANGES})")
def page_range_parse(spark, sf_dir):
    return X.sql(spark, X.RANGES).select("id", F.array_join(ranges.parse_pages(F.col("spec"), F.col("pages")), ",").alias("found"))


_TYPED = f"regexp_replace({STRIP.format('spec')}, '^[,，-]+|[,，-]+$', '', 'g')"


@query("clean_spec", f"SELECT id, {_TYPED} AS spec, array_to_string({_pages_sql(_TYPED)}, ',') AS found FROM ({X.SPECS})")
def clean_spec(spark, sf_dir):
    typed = ranges.clean_spec(F.col("spec"))
    return X.sql(spark, X.SPECS).select("id", typed.alias("spec"), F.array_join(ranges.parse_pages(typed, F.col("pages"), strict=False), ",").alias("found"))


@query("page_error", f"SELECT id, CASE WHEN encrypted THEN 'encrypted' WHEN f IS NULL THEN 'bad_range' WHEN len(f) = 0 THEN 'no_pages' END AS error FROM (SELECT *, {_pages_sql('spec')} AS f FROM ({X.SPECS}))")
def page_error(spark, sf_dir):
    return X.sql(spark, X.SPECS).select("id", ranges.page_error(F.col("spec"), F.col("pages"), F.col("encrypted")).alias("error"))


@query("contained_pages", f"SELECT id, array_to_string(CASE WHEN own = pages THEN range(0, pages) ELSE coalesce({_pages_sql('spec')}, range(0, pages)) END, ',') AS found FROM ({X.SPECS})")
def contained_pages(spark, sf_dir):
    return X.sql(spark, X.SPECS).select("id", F.array_join(ranges.contained_pages(F.col("spec"), F.col("own"), F.col("pages")), ",").alias("found"))


@query("page_range_format", """WITH p AS (SELECT DISTINCT source, doc_id % 40 AS page FROM documents), r AS (SELECT source, page, page - row_number() OVER (PARTITION BY source ORDER BY page) AS run FROM p),
g AS (SELECT source, min(page) AS a, max(page) AS z FROM r GROUP BY source, run) SELECT source, string_agg(CASE WHEN a = z THEN (a + 1)::VARCHAR ELSE (a + 1) || '-' || (z + 1) END, ',' ORDER BY a) AS spec FROM g GROUP BY source""")
def page_range_format(spark, sf_dir):
    return ranges.format_pages(_table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 40).alias("page")), "source")


_BATCHES = "b AS (SELECT source, doc_id, CASE WHEN o < 3 THEN 0 WHEN o < 13 THEN 1 WHEN o < 33 THEN 2 ELSE 3 + (o - 33) // 30 END::INT AS batch FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS o FROM documents))"


@query("page_batches", f"WITH {_BATCHES} SELECT source, doc_id AS page, batch FROM b")
def page_batches(spark, sf_dir):
    return resume.batches(_table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page")), "source").select("source", "page", "batch")


@query("resume_batches", f"WITH {_BATCHES} SELECT source, doc_id AS page, batch FROM b WHERE batch > 0 OR length(source) % 2 = 1")
def resume_batches(spark, sf_dir):
    """The first batch of each source is done; for some of them with other settings, so it is made again."""
    batched = resume.batches(_table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page")), "source")
    settings = lambda mode: resume.signature(F.col("source"), mode)
    now = batched.withColumn("signature", settings(F.lit("full")))
    done = batched.where("batch = 0").withColumn("signature", settings(F.when(F.length("source") % 2 == 1, "rules").otherwise("full")))
    return resume.todo(now, done, "source").select("source", "page", "batch")


@query("cross_batch_glossary", "SELECT source, arg_min(target, (batch, row_no)) AS target FROM (SELECT doc_id % 13 AS batch, doc_id AS row_no, lang || doc_id % 50 AS source, 't' || doc_id AS target FROM documents) WHERE batch < 7 GROUP BY source")
def cross_batch_glossary(spark, sf_dir):
    """What the eighth of thirteen batches is given."""
    number = F.col("doc_id")
    entries = _table(spark, sf_dir, "documents").select((number % 13).alias("batch"), number.alias("row_no"), F.concat("lang", number % 50).alias("source"), F.concat(F.lit("t"), number).alias("target"))
    return glossary.for_batch(entries, 7)


@query("glossary_for_engine", f"SELECT trim(source) AS source, arg_min(trim(target), (file_no, row_no)) AS target, 'llm' AS engine FROM ({X.GLOSSARY}) WHERE trim(target) <> '' GROUP BY 1")
def glossary_for_engine(spark, sf_dir):
    merged = glossary.merge(X.sql(spark, X.GLOSSARY))
    given = [glossary.for_engine(merged, e).withColumn("engine", F.lit(e)) for e in ("llm", "google", "microsoft")]
    return given[0].union(given[1]).union(given[2])


@query("job_totals", "SELECT event_type, sum(user_id)::BIGINT AS tokens, count(*) AS pages, sum(event_id % 100)::BIGINT AS seconds, sum(event_id % 100)::DOUBLE / count(*) AS pace FROM events GROUP BY event_type")
def job_totals(spark, sf_dir):
    batches = _table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("tokens"), (F.col("event_id") % 100).alias("seconds"), F.lit(1).cast("long").alias("pages"))
    return viewer.totals(batches, "event_type").select("event_type", "tokens", "pages", "seconds", "pace")


@query("job_progress", "SELECT user_id, arg_max(event_type, event_id) AS stage, (arg_max(event_id % 7, event_id) + arg_max(event_id % 100, event_id) / 100.0::DOUBLE) / 8 * 100 AS overall FROM events GROUP BY user_id")
def job_progress(spark, sf_dir):
    number = F.col("event_id")
    events = _table(spark, sf_dir, "events").select("user_id", number.alias("seq"), F.concat("event_type", F.lit("（3/20），预计 5 分钟")).alias("stage"), (number % 7).alias("done"), (number % 100).cast("double").alias("percent"), F.lit(8).alias("total"))
    return viewer.progress(events, "user_id")


@query("glossary_merge", f"SELECT trim(source) AS source, arg_min(trim(target), (file_no, row_no)) AS target FROM ({X.GLOSSARY}) WHERE trim(target) <> '' GROUP BY 1")
def glossary_merge(spark, sf_dir):
    return glossary.merge(X.sql(spark, X.GLOSSARY))


@query("glossary_keep_terms", f"SELECT array_to_string(list_sort(list_distinct(list(lower(target)))), ',') AS keep FROM (SELECT arg_min(trim(target), (file_no, row_no)) AS target FROM ({X.GLOSSARY}) WHERE trim(target) <> '' GROUP BY trim(source))")
def glossary_keep_terms(spark, sf_dir):
    return glossary.keep_terms(glossary.merge(X.sql(spark, X.GLOSSARY))).select(_joined("keep").alias("keep"))


@query("prior_results", "SELECT CASE lang WHEN 'fr' THEN 3 WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS label_no, lang AS label, doc_id FROM documents")
def prior_results(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return tables.labelled_union({x: docs.where(F.col("lang") == x).drop("lang") for x in ("fr", "es", "en", "de")}, "fr").select("label_no", "label", "doc_id")


@query("pending_pages", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def pending_pages(spark, sf_dir):
    ids = _table(spark, sf_dir, "documents").select("doc_id")
    return viewer.pending(ids.where("doc_id % 3 <> 0"), ids.where("doc_id % 5 = 0"), "doc_id")


@query("ordered_concat", "SELECT part, doc_id, lang FROM (SELECT 0 AS part, * FROM documents WHERE lang = 'en' UNION ALL SELECT 1, * FROM documents WHERE lang = 'fr' UNION ALL SELECT 2, * FROM documents WHERE lang = 'de' UNION ALL SELECT 3, * FROM documents WHERE lang = 'es') ORDER BY 1, 2")
def ordered_concat(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return tables.ordered_concat([docs.where(F.col("lang") == x) for x in ("en", "fr", "de", "es")], ["doc_id"]).select("part", "doc_id", "lang")


# --- viewer


_HEIGHT = "SELECT page_id // 25 AS doc, page_id AS page, (600 + length(html) % 300)::DOUBLE AS height FROM pages"
_TOPS = f"tops AS (SELECT doc, page, coalesce(sum(round(height * 1.5)::BIGINT + 8) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS top FROM ({_HEIGHT}))"


def _tops(spark, sf_dir) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 25).alias("doc"), F.col("page_id").alias("page"), (600 + F.length("html") % 300).cast("double").alias("height"))
    return viewer.page_tops(pages, "doc", 1.5, 8).select("doc", "page", "top")


@query("prefix_tops", f"WITH {_TOPS} SELECT * FROM tops")
def prefix_tops(spark, sf_dir):
    return _tops(spark, sf_dir)


@query("page_at_offset", f"WITH {_TOPS}, y AS (SELECT DISTINCT page_id // 25 AS doc, (page_id % 25) * 1111 AS y FROM pages) SELECT y.doc, y.y, max(page) AS page FROM y JOIN tops t ON t.doc = y.doc AND t.top <= y.y GROUP BY 1, 2")
def page_at_offset(spark, sf_dir):
    offsets = _table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 25).alias("doc"), ((F.col("page_id") % 25) * 1111).alias("y")).distinct()
    return viewer.page_at(_tops(spark, sf_dir), offsets, "doc")


@query("stage_change_log", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def stage_change_log(spark, sf_dir):
    return viewer.changes(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("engine_compare", "SELECT lang AS label, doc_id AS page, CASE WHEN doc_id % 3 = 0 THEN 'found' WHEN doc_id % 5 = 0 THEN 'running' ELSE 'outside' END AS state FROM documents")
def engine_compare(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), F.col("doc_id").alias("page"))
    return viewer.compare(rows, rows.where("page % 3 = 0"), rows.where("page % 5 = 0"))


@query("original_page", "SELECT lang AS label, doc_id % 7 AS serial, doc_id % 11 AS place, min(doc_id) AS page FROM documents GROUP BY 1, 2, 3")
def original_page(spark, sf_dir):
    index = _table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), (F.col("doc_id") % 7).alias("serial"), (F.col("doc_id") % 11).alias("place"), F.col("doc_id").alias("page"))
    return viewer.original_page(index, index.select("label", "serial", "place").distinct())


# --- layout: lines of a contents page made from the documents' first words


def _toc(spark, sf_dir) -> DataFrame:
    """Characters 5 wide of lines `n.m  words ... page`, a line for each document, its title the first English word: two
    documents in three get a number, one in two a page number."""
    docs = _table(spark, sf_dir, "documents")
    lead = F.when(F.col("doc_id") % 3 != 0, F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 5 + 1).cast("string"))).otherwise("")
    title = F.concat_ws("", F.lit("T"), F.regexp_extract("text", "[A-Za-z]+", 0))
    trail = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 300 + 1).cast("string")).otherwise("")
    rows = docs.select(F.col("doc_id").alias("line"), lead.alias("a"), title.alias("b"), trail.alias("c"))
    put = lambda c, x: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.struct(F.substring(F.col(c), i, F.lit(1)).alias("c"), (F.lit(float(x)) + (i - 1) * 5).alias("x")))
    some = lambda c, x: F.when(F.length(c) > 0, put(c, x)).otherwise(F.array().cast("array<struct<c:string,x:double>>"))
    chars = rows.select("line", F.posexplode(F.concat(some("a", 50), some("b", 100), some("c", 520))).alias("i", "s"))
    return chars.select("line", "i", "s.c", "s.x", (F.col("s.x") + 5).alias("x2"), F.lit(100.0).alias("y"), F.lit(107.0).alias("y2"), F.lit(10.0).alias("size"))


@query("toc_lines", "SELECT doc_id AS line, doc_id % 3 <> 0 AS has_lead, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 300 + 1)::VARCHAR END AS trail FROM documents")
def toc_lines(spark, sf_dir):
    return layout.marks(layout.printed_lines(_toc(spark, sf_dir))).select("line", F.col("lead_x").isNotNull().alias("has_lead"), "trail")


@query("line_sizes", "SELECT conv_id, turn, list_sort(list_transform(range(0, length(text)), lambda i: (8 + (i * 7 + conv_id) % 5)::DOUBLE))[length(text) // 2 + 1] AS size FROM conversations WHERE length(text) > 0")
def line_sizes(spark, sf_dir):
    """Characters of five sizes, a line for each turn."""
    turns = _table(spark, sf_dir, "conversations").where("length(text) > 0")
    chars = turns.select(F.struct("conv_id", "turn").alias("line"), F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("i"))
    return layout.font_sizes(chars.withColumn("size", (8 + (F.col("i") * 7 + F.col("line.conv_id")) % 5).cast("double"))).select("line.*", "size")


@query("entry_boxes", "SELECT line, least(y, min(cy)) AS y, greatest(y2, max(cy2)) AS y2 FROM (SELECT doc_id AS line, 101.0::DOUBLE AS y, 106.0::DOUBLE AS y2, 100.0::DOUBLE - doc_id % 3 + 2 AS cy, 105.0::DOUBLE + doc_id % 4 AS cy2 FROM documents) GROUP BY line, y, y2")
def entry_boxes(spark, sf_dir):
    shift = _toc(spark, sf_dir).withColumns({"y": F.col("y") - F.col("line") % 3 + 2, "y2": 105.0 + F.col("line") % 4})
    boxes = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.lit(101.0).alias("y"), F.lit(106.0).alias("y2"))
    return layout.entry_boxes(boxes, shift)


@query("page_widths", "SELECT page_id // 25 AS doc, max(400 + length(url) * 3.5)::DOUBLE AS width FROM pages GROUP BY 1")
def page_widths(spark, sf_dir):
    return viewer.page_widths(_table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 25).alias("doc"), (400 + F.length("url") * 3.5).cast("double").alias("width")), "doc")


@query("marked_blocks", """WITH l AS (SELECT doc_id // 40 AS block, doc_id % 3 <> 0 OR doc_id % 2 = 0 AS marked FROM documents)
SELECT block::VARCHAR AS block, n, marked, (marked >= 3 AND marked >= 0.4 * n) OR marked >= n AS is_list FROM (SELECT block, count(*) AS n, count(*) FILTER (marked) AS marked FROM l GROUP BY block)""")
def marked_blocks(spark, sf_dir):
    lines = layout.marks(layout.printed_lines(_toc(spark, sf_dir)))
    return layout.is_list(lines.select(F.floor(F.col("line") / 40).cast("string").alias("block"), "lead_x", "trail"))


@query(
    "toc_groups",
    """WITH RECURSIVE l AS (SELECT doc_id // 40 AS block, (doc_id % 40)::INT AS seq, doc_id % 3 <> 0 AS lead, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 300 + 1)::VARCHAR END AS trail FROM documents),
    b AS (SELECT block FROM l GROUP BY block HAVING (count(*) FILTER (lead OR trail IS NOT NULL) >= 3 AND count(*) FILTER (lead OR trail IS NOT NULL) >= 0.4 * count(*)) OR count(*) FILTER (lead OR trail IS NOT NULL) >= count(*)),
    o AS (SELECT l.*, CASE WHEN lead THEN 50 ELSE 100 END AS x, row_number() OVER (PARTITION BY block ORDER BY seq) AS n FROM l JOIN b USING (block)),
    g AS (SELECT block, seq, trail, n, 0 AS entry, CASE WHEN lead THEN 100 END AS text_x, trail IS NOT NULL AS closed FROM o WHERE n = 1
      UNION ALL SELECT o.block, o.seq, o.trail, o.n, CASE WHEN NOT o.lead AND NOT g.closed AND coalesce(abs(o.x - g.text_x) < 5, false) THEN g.entry ELSE g.entry + 1 END,
        CASE WHEN NOT o.lead AND NOT g.closed AND coalesce(abs(o.x - g.text_x) < 5, false) THEN g.text_x WHEN o.lead THEN 100 END,
        o.trail IS NOT NULL FROM g JOIN o ON o.block = g.block AND o.n = g.n + 1)
    SELECT block::VARCHAR AS block, seq, entry, trail FROM g""",
)
def toc_groups(spark, sf_dir):
    lines = layout.marks(layout.printed_lines(_toc(spark, sf_dir)))
    lines = lines.select(F.floor(F.col("line") / 40).cast("string").alias("block"), (F.col("line") % 40).cast("int").alias("seq"), "x", "lead_x", "trail", "em", "text")
    lists = layout.is_list(lines).where("is_list").select("block")
    return layout.entries(lines.join(lists, "block")).select("block", "seq", "entry", "trail")

"""The queries of the training-data problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from newslake.llm import batches, copies, language, lines, mixing, packing, sentences
from newslake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found_languages(table(spark, d, "documents"), table(spark, d, "blogs_posts"), table(spark, d, "collect_headlines"))


def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    return language.all_stretches(table(spark, d, "documents"), table(spark, d, "blogs_posts"), table(spark, d, "collect_headlines"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return copies.all_records(*(table(spark, d, t) for t in ("headlines", "unified_headlines", "raw_lines")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_records(spark, d)).distinct()


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(_records(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_places(table(spark, d, "documents"), table(spark, d, "headlines"))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return lines.by_deltas(lines.halves(lines.document_rows(table(spark, d, "documents"))))


def p5_cleaned_titles(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "headlines")
    return lines.cleaned_titles(heads, lines.repeated(lines.count_lines(lines.title_rows(heads))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return batches.known_stories(table(spark, d, "headlines"), table(spark, d, "incoming"), table(spark, d, "site_labels"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def p8_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Containers where all three limits bind: at most 1,024 loss-bearing tokens and 12 documents."""
    return packing.containers(table(spark, d, "documents"), segments=12, loss_limit=1024)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_sized(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mixture of a given size, 250 tokens a document of the table: small sources are repeated up to their caps and miss their shares."""
    documents = table(spark, d, "documents")
    return mixing.mixture(documents, table(spark, d, "mix_targets"), total=250 * documents.count())[1]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_stretches, p2_found, p2_collapsed, p5_found, p5_cleaned, p5_cleaned_titles, p7_found, p8_containers, p8_instructions, p9_mixture, p9_shares, p9_sized, p10_found)
}

_SITE = "regexp_replace(lower(trim(domain)), '^www\\.|\\.$', '', 'g')"
_TEXT = "upper(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_LETTERS = "upper(regexp_replace({}, '[^\\p{{L}}]+', '', 'g'))"

_RECORDS = f"""
with r as (
  select 'headlines' as tbl, row_id as id, coalesce({_SITE}, '') || chr(31) || {_TEXT.format('title')} as k from headlines where {_TEXT.format('title')} <> ''
  union all
  select 'unified_headlines', row_id, {_TEXT.format('key')} from unified_headlines where {_TEXT.format('key')} <> ''
  union all
  select 'raw_lines', line_id, list_aggregate(list_sort(list_transform(json_keys(j), lambda f: f || chr(30) || {_TEXT.format("json_extract_string(j, '$.\"' || f || '\"')")})), 'string_agg', chr(31))
  from (select line_id, case when json_valid(line) then line::json end as j from raw_lines) where j is not null
)"""

_LINES = f"""
with lines as (
  select 'documents' as tbl, doc_id as id, coalesce(source, '') as source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
  union all
  select 'headlines', row_id, s, unnest(p), generate_subscripts(p, 1) from (
    select row_id, coalesce({_SITE}, '') as s, string_split_regex(trim(regexp_replace(regexp_replace(title, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')), ' [|\\-–—] ') as p from headlines)
), keyed as (select *, {_LETTERS.format('line')} as k from lines),
totals as (
  select 'documents' as tbl, coalesce(source, '') as source, count(*) as n from documents group by all
  union all select 'headlines', coalesce({_SITE}, ''), count(*) from headlines group by all
),
found as (
  select tbl, source, k from (select tbl, source, k, count(distinct id) as n from keyed where k <> '' group by all) c
  join totals t using (tbl, source) where c.n >= 4 and c.n >= t.n * 0.05
)"""

_TIDY = f"trim(regexp_replace(regexp_replace(title, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"

ORACLES: dict[str, str] = {
    "p2_found": _RECORDS + "select distinct tbl, keep_id, id as copy_id from (select tbl, id, min(id) over (partition by tbl, k) as keep_id from r) where id <> keep_id",
    "p2_collapsed": _RECORDS + "select tbl, min(id) as keep_id, count(*) as copies from r group by tbl, k",
    "p5_found": _LINES + "select tbl, id, pos from keyed join found using (tbl, source, k)",
    "p5_cleaned": _LINES
    + """, kept as (select id, string_agg(line, chr(10) order by pos) as text from keyed left join found f using (tbl, source, k) where tbl = 'documents' and f.k is null group by id)
select 'documents' as tbl, doc_id as id, case when d.text is not null then coalesce(kept.text, '') end as text from documents d left join kept on d.doc_id = kept.id""",
    "p5_cleaned_titles": _LINES
    + f""", gaps as (select row_id as id, title, regexp_extract_all({_TIDY}, ' [|\\-–—] ') as g from headlines),
kept as (select k.id, pos, line, g[pos - 1] as gap, row_number() over (partition by k.id order by pos) as r
  from keyed k left join found f using (tbl, source, k) join gaps on gaps.id = k.id where tbl = 'headlines' and f.k is null),
texts as (select id, string_agg(case when r = 1 then line else gap || line end, '' order by pos) as text from kept group by id)
select 'headlines' as tbl, gaps.id, case when title is not null then coalesce(text, '') end as text from gaps left join texts using (id)""",
}

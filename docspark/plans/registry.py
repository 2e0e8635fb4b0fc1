"""The register of queries: a name, a function of (spark, sf_dir), and the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The lines and runs of operators/runs.py.
LINES = """lines as (
  select doc_id, i as line_no, p[i + 1] as line from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null), unnest(range(len(p))) as t(i)
  where p[i + 1] <> '')"""
RUNS = f"""{LINES},
runs as (
  select doc_id, line_no, line_no // 40 + 1 as page, 740.0::double - 18 * (line_no % 40) as y, (case when line_no % 17 = 0 then 22.0 when line_no % 9 = 0 then 16.0 else 11.0 end)::double as size,
    case when line_no % 7 = 3 then 'Figure ' || line_no || ': ' || line when line_no % 5 = 2 then '- ' || line else line end as text
  from lines)"""
IS_CAPTION = r"""(len(string_split_regex(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), '\s+')) <= 15 and regexp_matches({0}, '^\s*(?:[Ff][Ii][Gg][Uu][Rr][Ee]|[Ff][Ii][Gg]|[Tt][Aa][Bb][Ll][Ee]|[Ee][Xx][Hh][Ii][Bb][Ii][Tt]|[Cc][Hh][Aa][Rr][Tt]|[Dd][Ii][Aa][Gg][Rr][Aa][Mm]|[Pp][Ll][Aa][Tt][Ee])\.*\s+[0-9]\S*[:.)\-–—](?:\s|$)'))"""
CLASSIFY = r"""case when regexp_matches(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), '^(?:[•*–·‣◦-]|[0-9]+[.)])') then 'List' else 'Paragraph' end"""
TOKENS = "greatest(1, (length({0}) + 3) // 4)::bigint"
BLOCKS = f"""{RUNS},
counts as (select doc_id, round(size) as s, count(*) as n from runs group by all),
body as (select doc_id, arg_min(s, (-n, s)) as body from counts group by doc_id),
marked as (
  select r.*, body, size > 1.25 * body as heading, lag(size) over w as p_size, lag(y) over w as p_y, lag(page) over w as p_page
  from runs r join body using (doc_id) window w as (partition by doc_id order by line_no)),
broken as (
  select *, case when not heading and p_page = page and not p_size > 1.25 * body and abs(p_size - size) <= 0.15 * size and p_y - y <= 1.9 * size + 4 then 0 else 1 end as opens from marked),
numbered as (select *, (sum(opens) over (partition by doc_id order by line_no) - 1)::int as block_ix from broken),
raw_blocks as (
  select doc_id, block_ix, any_value(page) as page, bool_or(heading) as heading, arg_min(text, line_no) as first_text, string_agg(text, chr(10) order by line_no) as text, arg_min(size, line_no) as size
  from numbered group by doc_id, block_ix),
blocks as (
  select doc_id, block_ix, page, size, text, case when heading then 'Heading' when {IS_CAPTION.format("text")} then 'Caption' else {CLASSIFY.format("first_text")} end as kind from raw_blocks)"""


def packed(target: int, step: int = 18) -> str:
    """Chunk numbers of the blocks, greedily, by recursion over each document's blocks."""
    return f"""{BLOCKS.replace("740.0::double - 18 *", f"740.0::double - {step} *")},
walk as (
  select doc_id, block_ix, kind, page, 0 as chunk_ix, {TOKENS.format("text")} as used,
    case when kind = 'Heading' then [{{'size': size, 'text': text}}] else [] end as stack, []::varchar[] as path
  from blocks where block_ix = 0
  union all
  select doc_id, block_ix, kind, page, chunk_ix + fresh::int, case when fresh then cost else used + cost end,
    case when kind = 'Heading' then list_append(above, {{'size': size, 'text': text}}) else above end, path
  from (
    select *, (kind = 'Heading' or p_kind = 'Heading' or p_page <> page or p_path <> path or p_kind <> kind or used + cost > {target}) as fresh
    from (
      select *, [x.text for x in above] as path from (
        select b.*, {TOKENS.format("b.text")} as cost, w.chunk_ix, w.used, w.kind as p_kind, w.page as p_page, w.path as p_path,
          case when b.kind = 'Heading' then [x for x in w.stack if x.size > b.size] else w.stack end as above
        from walk w join blocks b on b.doc_id = w.doc_id and b.block_ix = w.block_ix + 1)))),
chunks as (
  select doc_id, chunk_ix, any_value(kind) as kind, any_value(page) as page, arg_min(path, block_ix) as path, string_agg(text, chr(10) order by block_ix) as text
  from walk join blocks using (doc_id, block_ix, kind, page) group by doc_id, chunk_ix)"""

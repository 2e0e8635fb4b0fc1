"""Runs, lines, blocks, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chunks as C, layout as L, runs as R, serialize as S
from .registry import BLOCKS, LINES, RUNS, TOKENS, packed, query, table


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.synthetic_runs(table(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return C.chunk_runs(synthetic(spark, sf_dir), **options)


@query(f"with recursive {packed(512)}, offsets as (select *, length(text) as char_len, coalesce(sum(length(text) + 2) over (partition by doc_id order by chunk_ix rows between unbounded preceding and 1 preceding), 0)::bigint as char_start from chunks) "
       f"select doc_id, chunk_ix, page::int as page, kind, sha256(text) as text_sha256, array_to_string(path, ' > ') as heading_path, char_start, char_len, {TOKENS.format('text')} as token_estimate from offsets")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.finalize(chunks(spark, sf_dir), with_id=False)
    return made.select("doc_id", "chunk_ix", "page", "kind", F.sha2("text", 256).alias("text_sha256"), F.array_join("heading_path", " > ").alias("heading_path"), "char_start", "char_len", "token_estimate")


@query(f"with recursive {packed(64)} select doc_id, kind, count(*) as chunks, max({TOKENS.format('text')}) as largest from chunks group by all")
def chunk_small_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, target_tokens=64).groupBy("doc_id", "kind").agg(F.count("*").alias("chunks"), F.max("token_estimate").alias("largest"))


@query(f"with recursive {packed(256, 30)} select doc_id, chunk_ix, page::int as page, kind, sha256(text) as text_sha256, {TOKENS.format('text')} as token_estimate from chunks")
def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines too far apart to be one block, packed up to 256 tokens."""
    runs = R.synthetic_runs(table(spark, sf_dir, "documents"), step=30.0)
    return C.pack(C.blocks(runs), target_tokens=256).select("doc_id", "chunk_ix", "page", "kind", F.sha2("text", 256).alias("text_sha256"), "token_estimate")


@query(f"""with recursive {packed(64, 30)},
texts as (select doc_id, chunk_ix, kind, page, path, text, lag(text) over w as p_text, lag(kind) over w as p_kind, lag(page) over w as p_page, lag(path) over w as p_path from chunks window w as (partition by doc_id order by chunk_ix)),
grown as (
  select doc_id, chunk_ix, text, text as whole from texts where chunk_ix = 0
  union all
  select t.doc_id, t.chunk_ix, t.text,
    case when t.kind <> 'Heading' and t.p_kind = t.kind and t.p_page = t.page and t.p_path = t.path and seed <> '' then seed || chr(10) || t.text else t.text end
  from (select g.doc_id, g.chunk_ix + 1 as n, trim(case when length(g.whole) <= 64 then g.whole when regexp_matches(right(g.whole, 64), '\\s') then regexp_replace(right(g.whole, 64), '^\\S+', '') else right(g.whole, 64) end, ' ' || chr(9) || chr(10) || chr(13)) as seed from grown g) g
  join texts t on t.doc_id = g.doc_id and t.chunk_ix = g.n)
select doc_id, chunk_ix, sha256(whole) as text_sha256, {TOKENS.format("whole")} as token_estimate from grown""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that begin with the end of the one before, where only the budget parted them."""
    runs = R.synthetic_runs(table(spark, sf_dir, "documents"), step=30.0)
    return C.chunk_runs(runs, target_tokens=64, overlap_tokens=16).select("doc_id", "chunk_ix", F.sha2("text", 256).alias("text_sha256"), "token_estimate")


@query(f"with recursive {packed(512)} select doc_id, sha256(string_agg(text, chr(10) || chr(10) order by chunk_ix)) as text_sha256 from chunks group by doc_id")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_text(chunks(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"with recursive {packed(512)} select count(*)::bigint as chunks, count(*)::bigint as sliced from chunks")
def char_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text is what its offsets slice from its document's text."""
    made = C.offsets(chunks(spark, sf_dir).drop("char_start", "char_len"))
    whole = C.document_text(made).withColumnRenamed("text", "whole")
    cut = F.substring("whole", F.col("char_start").cast("int") + 1, F.col("char_len").cast("int"))
    return made.join(whole, "doc_id").agg(F.count("*").alias("chunks"), F.sum((cut == F.col("text")).cast("bigint")).alias("sliced"))


@query(f"""with recursive {packed(512)},
keys as (select doc_id, chunk_ix, page, lower(kind) as kind, hex(encode(text)) as h from chunks),
bytes as (select doc_id, chunk_ix, [page, 0, 0, 0, 0, 0, 0, 0] || [ascii(c) for c in string_split(kind, '')] || [0] || [('0x' || substr(h, 2 * i + 1, 2))::int for i in range(length(h) // 2)] as b from keys)
select doc_id, chunk_ix, lower(lpad(hex(list_reduce([14695981039346656037::uhugeint] || [x::uhugeint for x in b], lambda a, x: (xor(a, x) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::ubigint), 16, '0')) as id from bytes""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of all chunks."""
    return chunks(spark, sf_dir).select("doc_id", "chunk_ix", C.stable_id(F.col("page"), F.col("kind"), F.col("text")).alias("id"))


@query(f"with {BLOCKS} select doc_id, block_ix, page::int as page, kind, size, sha256(text) as text_sha256 from blocks")
def group_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = synthetic(spark, sf_dir)
    made = C.group_blocks(L.lines(runs), C.body_size(runs))
    return made.select("doc_id", "block_ix", "page", "kind", "size", F.sha2("text", 256).alias("text_sha256"))


@query(f"with {BLOCKS} select kind, count(*) as blocks, sum(length(text))::bigint as chars from blocks group by kind")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.blocks(synthetic(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query(f"""with {BLOCKS},
heads as (select doc_id, block_ix, size, text from blocks where kind = 'Heading'),
above as (
  select b.doc_id, b.block_ix, h.block_ix as h_ix, h.text, h.size as h_size, b.kind, b.size,
    (select max(m.size) from heads m where m.doc_id = b.doc_id and m.block_ix > h.block_ix and m.block_ix < b.block_ix) as between_size
  from blocks b join heads h on h.doc_id = b.doc_id and h.block_ix < b.block_ix),
kept as (select * from above where (between_size is null or h_size > between_size) and (kind <> 'Heading' or h_size > size))
select b.doc_id, b.block_ix, coalesce(string_agg(k.text, ' > ' order by k.h_ix), '') as heading_path
from blocks b left join kept k on k.doc_id = b.doc_id and k.block_ix = b.block_ix group by all""")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.heading_paths(C.blocks(synthetic(spark, sf_dir)))
    return made.select("doc_id", "block_ix", F.array_join("heading_path", " > ").alias("heading_path"))


@query(f"with {RUNS}, counts as (select doc_id, round(size) as s, count(*) as n from runs group by all) select doc_id, arg_min(s, (-n, s)) as body from counts group by doc_id")
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.body_size(synthetic(spark, sf_dir))


@query(f"with {RUNS} select doc_id, page::int as page, list_sort(list(size))[count(*) // 2 + 1] as median from runs group by doc_id, page")
def median_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.median_size(synthetic(spark, sf_dir))


@query(f"with {RUNS} select doc_id, page::int as page, (row_number() over (partition by doc_id, page order by line_no) - 1)::int as line_ix, text, y, size from runs")
def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines(synthetic(spark, sf_dir)).select("doc_id", "page", "line_ix", "text", "y", "size")


@query(f"with {LINES}, words as (select doc_id, line_no, array_to_string([w for w in string_split_regex(line, ' +') if w <> ''], ' ') as text from lines) "
       "select doc_id, (line_no // 40 + 1)::int as page, (row_number() over (partition by doc_id, line_no // 40 order by line_no) - 1)::int as line_ix, text from words where text <> ''")
def word_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words placed side by side come together as their lines."""
    return L.lines(R.word_runs(table(spark, sf_dir, "documents"))).select("doc_id", "page", "line_ix", "text")


@query(f"""with {RUNS},
prior as (select *, lag(y) over (partition by doc_id, page order by line_no) as p_y from runs)
select doc_id, page::int as page, sha256(string_agg(case when p_y is null then '' when p_y - y > 1.8 * size then chr(10) || chr(10) else chr(10) end || rtrim(text, ' ' || chr(9) || chr(13)), '' order by line_no)) as text_sha256
from prior group by doc_id, page""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_text(L.lines(synthetic(spark, sf_dir))).select("doc_id", "page", F.sha2("text", 256).alias("text_sha256"))


@query(f"""with recursive {packed(512)},
parts as (select doc_id, chunk_ix, case
    when kind = 'Heading' then repeat('#', least(len(path) + 1, 6)) || ' ' || regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '(^|\\n)([ \\t]*)([#>|])', '\\1\\2\\\\\\3', 'g')
    when kind = 'Caption' then '*' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || '*'
    when kind = 'List' then rtrim(text, ' ' || chr(9) || chr(10) || chr(13))
    else regexp_replace(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)), '(^|\\n)([ \\t]*)([#>|])', '\\1\\2\\\\\\3', 'g') end as part from chunks)
select doc_id, sha256(string_agg(part, chr(10) || chr(10) order by chunk_ix)) as markdown_sha256 from parts group by doc_id""")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_markdown(chunks(spark, sf_dir)).select("doc_id", F.sha2("markdown", 256).alias("markdown_sha256"))


@query(f"""with recursive {packed(512)}
select doc_id, count(*) as chunks, sum(length(text))::bigint as chars, string_agg(kind, ',' order by chunk_ix) as kinds, sum(len(path))::bigint as path_length from chunks group by doc_id""")
def chunk_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as JSON and read back."""
    made = S.to_json(C.finalize(chunks(spark, sf_dir)))
    one = "array<struct<id:string,text:string,page:int,kind:string,heading_path:array<string>,char_start:bigint,char_len:bigint,token_estimate:bigint>>"
    back = made.select("doc_id", F.from_json("json", one).alias("c"))
    return back.select(
        "doc_id", F.size("c").cast("bigint").alias("chunks"), F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x.text)).alias("chars"),
        F.array_join(F.transform("c", lambda x: x.kind), ",").alias("kinds"), F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x.heading_path)).alias("path_length"),
    )


@query(f"""with recursive {packed(512)}
select doc_id, chunk_ix, case when len(path) = 0 then '(p.' || page || ')' else array_to_string(path, ' > ') || ' (p.' || page || ')' end as context from chunks""")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.finalize(chunks(spark, sf_dir), contextual_prefix=True, with_id=False).select("doc_id", "chunk_ix", "context")

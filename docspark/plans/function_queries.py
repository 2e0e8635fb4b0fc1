"""The function library, over every line of the documents and the numbers of lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G, text as T
from ..operators import runs as R
from .registry import CLASSIFY, IS_CAPTION, LINES, TOKENS, query, table

WHITE = "' ' || chr(9) || chr(10) || chr(13)"


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text): lines announced as captions or items at fixed places, with signs that need escaping."""
    n = F.col("line_no")
    rows = R.text_lines(table(spark, sf_dir, "documents"))
    text = F.when(n % 7 == 3, F.concat(F.lit("Figure "), n, F.lit(": "), F.col("line"))).when(n % 7 == 4, F.concat(F.lit("  table "), n, F.lit(") "), F.col("line")))
    text = text.when(n % 5 == 1, F.concat(F.lit("- "), F.col("line"))).when(n % 5 == 2, F.concat(n, F.lit(". "), F.col("line"))).when(n % 5 == 3, F.concat(F.lit("# <b>\"x\" & 'y'</b>, "), F.col("line"))).otherwise(F.col("line"))
    return rows.select("doc_id", "line_no", text.alias("text"))


MARKED = f"""{LINES},
marked as (select doc_id, line_no::int as line_no, case when line_no % 7 = 3 then 'Figure ' || line_no || ': ' || line when line_no % 7 = 4 then '  table ' || line_no || ') ' || line
  when line_no % 5 = 1 then '- ' || line when line_no % 5 = 2 then line_no || '. ' || line when line_no % 5 = 3 then '# <b>"x" & ''y''</b>, ' || line else line end as text from lines)"""


@query(f"with {MARKED} select doc_id, line_no, {IS_CAPTION.format('text')} as is_caption from marked")
def is_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(spark, sf_dir).select("doc_id", "line_no", T.is_caption(F.col("text")).alias("is_caption"))


@query(f"with {MARKED} select doc_id, line_no, {CLASSIFY.format('text')} as kind from marked")
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(spark, sf_dir).select("doc_id", "line_no", T.classify_text(F.col("text")).alias("kind"))


@query(f"select doc_id, {TOKENS.format('text')} as tokens from documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"select doc_id, trim(case when length(text) <= 64 then text when regexp_matches(right(text, 64), '\\s') then regexp_replace(right(text, 64), '^\\S+', '') else right(text, 64) end, {WHITE}) as tail from documents")
def tail_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tail_tokens(F.col("text"), 16).alias("tail"))


@query(f"""with {MARKED} select doc_id, line_no, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as html from marked""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(spark, sf_dir).select("doc_id", "line_no", T.html_escape(F.col("text")).alias("html"))


@query(f"""with {MARKED} select doc_id, line_no, case when regexp_matches(text, '[,"\\n\\r]|^\\s|\\s$') then '"' || replace(text, '"', '""') || '"' else text end as field from marked""")
def csv_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(spark, sf_dir).select("doc_id", "line_no", T.csv_field(F.col("text")).alias("field"))


@query(f"with {MARKED} select doc_id, line_no, regexp_replace(text, '^([ \\t]*)([#>|])', '\\1\\\\\\2') as escaped from marked")
def escape_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(spark, sf_dir).select("doc_id", "line_no", T.escape_block_markers(F.col("text")).alias("escaped"))


@query("select doc_id, length(regexp_replace(text, '\\s', '', 'g'))::int as chars, translate(text, chr(10) || chr(13) || chr(9), '   ') as folded from documents")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.non_space_count(F.col("text")).alias("chars"), T.fold_breaks(F.col("text")).alias("folded"))


@query("select conv_id, turn, case when turn % 3 = 0 then '' else role || ' > ' end || case when turn % 2 = 0 then 'part > ' || (turn // 2)::varchar || ' ' else '' end as raw, "
       "case when turn % 3 = 0 and turn % 2 <> 0 then '(p.' || turn || ')' else array_to_string(case when turn % 3 = 0 then [] else [role] end || case when turn % 2 = 0 then ['part', (turn // 2)::varchar] else [] end, ' > ') || ' (p.' || turn || ')' end as context from conversations")
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    title = F.when(turn % 3 == 0, F.when(turn % 2 == 0, F.lit(None).cast("string")).otherwise("")).otherwise(F.col("role"))
    half = F.floor(turn / 2).cast("string")
    path = F.when(turn % 2 == 0, F.array(F.lit("part"), half)).otherwise(F.array().cast("array<string>"))
    raw = F.concat(F.when(turn % 3 == 0, "").otherwise(F.concat(F.col("role"), F.lit(" > "))), F.when(turn % 2 == 0, F.concat(F.lit("part > "), half, F.lit(" "))).otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"), T.context_prefix(title, path, turn).alias("context"))


@query("""with d as (select page_id, 300.0 + page_id % 700 as w, 200.0 + page_id % 900 as h, page_id % 5 as mode, 50 + page_id % 4000 as side from pages),
s as (select *, case mode when 0 then w * 150.0 / 72 when 1 then side when 2 then side * w / h when 3 then w * side / 720.0 else w * 2.5 end as ow, case mode when 0 then h * 150.0 / 72 when 1 then side * h / w when 2 then side when 3 then h * side / 720.0 else h * 2.5 end as oh from d),
r as (select page_id, greatest(1, floor(ow + 0.5))::bigint as width, greatest(1, floor(oh + 0.5))::bigint as height from s)
select *, width > 10000 or height > 10000 or width * height > 4000000 as over from r""")
def output_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    mode, side = p % 5, (50 + p % 4000).cast("double")
    pick = lambda k, v: F.when(mode == k, v)
    out = G.output_dimensions(300.0 + p % 700, 200.0 + p % 900, width=pick(1, side), height=pick(2, side), dpi=pick(3, side / 10.0), scale=pick(4, F.lit(2.5)))
    return table(spark, sf_dir, "pages").select("page_id", out.alias("d")).select("page_id", "d.width", "d.height", F.col("d.error").isNotNull().alias("over"))


@query("select l_orderkey, l_linenumber, (((l_partkey - 1000) * 30 % 360) + 360) % 360 as rotation, (l_partkey - 1000) * 30 % 90 = 0 as valid, case when l_suppkey - 50 < 0 then 1 else least(greatest((l_suppkey - 50) * 30, 1), 1000) end as span from lineitem")
def rotations_and_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned, span = (F.col("l_partkey") - 1000) * 30, (F.col("l_suppkey") - 50) * 30
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.normalize_rotation(turned).alias("rotation"), G.valid_rotation(turned).alias("valid"), G.clamp_span(span).alias("span"))


BOX = "l_quantity as a, l_extendedprice as b, l_partkey % 300 + 0.5 as c, l_suppkey % 40 + 0.25 as d"


@query(f"with q as (select l_orderkey, l_linenumber, {BOX} from lineitem) select l_orderkey, l_linenumber, least(a, c)::double as x0, least(b, d)::double as y0, greatest(a, c)::double as x1, greatest(b, d)::double as y1 from q")
def normalize_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_partkey") % 300 + F.lit(0.5), F.col("l_suppkey") % 40 + F.lit(0.25)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.normalize_rect(a, b, c, d).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("""with q as (select l_orderkey, l_linenumber, l_quantity as a, (l_partkey % 7)::double as b, (l_suppkey % 5)::double as c, (l_linenumber * 2)::double as d, (l_partkey % 100)::double as e, (l_suppkey % 50)::double as f from lineitem)
select l_orderkey, l_linenumber, e + least(0, a, c, a + c) as x0, f + least(0, b, d, b + d) as y0, e + greatest(0, a, c, a + c) as x1, f + greatest(0, b, d, b + d) as y1,
  a * 2 + b * 1 as ma, a * 0 + b * 3 as mb, e * 2 + f * 1 + 10 as me, e * 0 + f * 3 + 20 as mf from q""")
def image_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    m = {"a": F.col("l_quantity"), "b": (p % 7).cast("double"), "c": (s % 5).cast("double"), "d": (F.col("l_linenumber") * 2).cast("double"), "e": (p % 100).cast("double"), "f": (s % 50).cast("double")}
    n = G.multiply(m, {k: F.lit(v) for k, v in zip("abcdef", (2.0, 0.0, 1.0, 3.0, 10.0, 20.0), strict=True)})
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.image_bbox(m).alias("box"), *(n[k].alias(f"m{k}") for k in "abef"))
    return rows.select("l_orderkey", "l_linenumber", "box.*", "ma", "mb", "me", "mf")


@query("""with q as (select l_orderkey, l_linenumber, l_linenumber * 0.25 as x0, l_quantity as y0, l_linenumber * 0.25 + (l_suppkey % 3) * 0.25 as x1, l_quantity + (l_partkey % 5) * 0.25 as y1 from lineitem),
s as (select *, abs(x1 - x0) as dx, abs(y1 - y0) as dy from q)
select l_orderkey, l_linenumber, case when dx <= 0.5 and dy > 0.5 then true when dy <= 0.5 and dx > 0.5 then false end as vertical,
  (case when dx <= 0.5 and dy > 0.5 then (x0 + x1) / 2 when dy <= 0.5 and dx > 0.5 then (y0 + y1) / 2 end)::double as pos,
  (case when dx <= 0.5 and dy > 0.5 then least(y0, y1) when dy <= 0.5 and dx > 0.5 then least(x0, x1) end)::double as lo from s""")
def rule_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("l_linenumber") * F.lit(0.25), F.col("l_quantity")
    s = G.segment(x0, y0, x0 + (F.col("l_suppkey") % 3) * F.lit(0.25), y0 + (F.col("l_partkey") % 5) * F.lit(0.25))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.vertical", "s.pos", "s.lo")


@query("""with q as (select l_orderkey, l_linenumber, (l_partkey % 700)::double - 50 as x0, (l_suppkey % 90)::double as y0, (l_partkey % 700)::double - 50 + l_quantity as x1, (l_suppkey % 90)::double + l_quantity * 2 as y1 from lineitem),
p as (select *, least(greatest(floor(x0 * 1.5), 0), 900)::bigint as l, least(greatest(ceil(x1 * 1.5), 0), 900)::bigint as r, least(greatest(floor(1200 - y1 * 1.5), 0), 1200)::bigint as t, least(greatest(ceil(1200 - y0 * 1.5), 0), 1200)::bigint as b from q)
select l_orderkey, l_linenumber, l as "left", t as top, greatest(r - l, 0) as width, greatest(b - t, 0) as height from p""")
def crop_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = (F.col("l_partkey") % 700).cast("double") - 50, (F.col("l_suppkey") % 90).cast("double")
    rect = {"x0": x0, "y0": y0, "x1": x0 + F.col("l_quantity"), "y1": y0 + F.col("l_quantity") * 2}
    out = G.crop_pixels(rect, F.lit(600.0), F.lit(800.0), F.lit(900), F.lit(1200))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", out.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("select doc_id, 'data:image/png;base64,' || to_base64(encode(text)) as url from documents")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.data_url(F.col("text").cast("binary")).alias("url"))


@query("select doc_id, doc_id % 2 = 0 as is_pdf from documents")
def pdf_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("junk ")).otherwise(F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.lit("%PDF-1.7\n")).otherwise(F.lit("%PS-1\n")), F.col("text")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", T.is_pdf(content).alias("is_pdf"))

"""Documents written as PDF, changed, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import edit as E, layout as L, render as RD
from ..sources.pdf import from_binary, parsed_tables
from .registry import LINES, query, table

#: Printable ASCII; what a base font writes without an encoding.
ASCII = "[^ -~]"


def draw_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text for each line of a document, 40 on a page, ASCII only."""
    n = F.col("line_no")
    from ..operators.runs import text_lines

    rows = text_lines(table(spark, sf_dir, "documents"))
    text = F.trim(F.regexp_replace("line", ASCII, ""))
    made = rows.select("doc_id", (F.floor(n / 40) + 1).cast("int").alias("page"), n.cast("int").alias("op_ix"), text.alias("text"), F.lit(72.0).alias("x"), (740 - 18.0 * (n % 40)).alias("y"), F.lit(11.0).alias("size"), F.lit("Helvetica").alias("font"))
    return made.where("text <> ''")


OPS = f"{LINES}, ops as (select doc_id, line_no, line_no // 40 + 1 as page, trim(regexp_replace(line, '{ASCII}', '', 'g'), ' ') as text, 740 - 18 * (line_no % 40) as y from lines where trim(regexp_replace(line, '{ASCII}', '', 'g'), ' ') <> '')"


def documents(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    titles = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang")).alias("title"))
    return E.build(draw_ops(spark, sf_dir), titles=titles, **options)


@query(f"with {OPS} select doc_id, page::int as page, text, y::double as y, 72 + length(text) * 5.5 as x1 from ops")
def pdf_round_trip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs read back from written files: text, place and width."""
    parsed = from_binary(documents(spark, sf_dir), want=("runs",))
    return parsed_tables(parsed)["runs"].select("doc_id", "page", "text", F.round("y0", 3).alias("y"), F.round("x1", 3).alias("x1"))


@query(f"with {OPS} select doc_id, page::int as page, sha256(string_agg(case when p_y is null then '' when p_y - y > 19.8 then chr(10) || chr(10) else chr(10) end || text, '' order by line_no)) as text_sha256 from (select *, lag(y) over (partition by doc_id, page order by line_no) as p_y from ops) group by doc_id, page")
def pdf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page, blank lines included."""
    runs = parsed_tables(from_binary(documents(spark, sf_dir, classic=True), want=("runs",)))["runs"]
    return L.page_text(L.lines(runs)).select("doc_id", "page", F.sha2("text", 256).alias("text_sha256"))


@query(f"with {OPS} select doc_id, 'Document ' || doc_id || ' ' || lang as title, max(page)::int as page_count, false as encrypted from ops join documents using (doc_id) group by doc_id, lang")
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_tables(from_binary(documents(spark, sf_dir), want=()))["doc_meta"].select("doc_id", "title", "page_count", "encrypted")


@query(f"with {OPS}, n as (select doc_id, max(page) as n from ops group by doc_id) select doc_id // 4 as group_id, sum(n)::int as pages from n group by all having count(*) > 1")
def pdf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents merged by fours: their pages add up."""
    docs = documents(spark, sf_dir).withColumn("group_id", F.floor(F.col("doc_id") / 4))
    merged = E.merge_groups(docs, by="group_id", order="doc_id")
    return merged.where("merged.value is not null").select("group_id", E.page_count(F.col("merged.value")).value.alias("pages"))


@query(f"with {OPS}, n as (select doc_id, max(page) as n from ops group by doc_id) select doc_id, case when n >= 2 then 'parts 1 ' || (n - 1) end as parts, case when n < 2 then 'page_out_of_range' end as error from n")
def pdf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page, and the others; documents of one page have no others."""
    docs = documents(spark, sf_dir)
    counted = docs.withColumn("n", E.page_count(F.col("content")).value)
    ranges = F.array(F.array(F.lit(1), F.lit(1)), F.array(F.lit(2), F.greatest(F.col("n"), F.lit(2))))
    out = counted.select("doc_id", E.split(F.col("content"), ranges).alias("s"))
    pages = lambda k: E.page_count(F.get("s.value", F.lit(k))).value.cast("string")
    return out.select("doc_id", F.when(F.col("s.error").isNull(), F.concat(F.lit("parts "), pages(0), F.lit(" "), pages(1))).alias("parts"), F.col("s.error").alias("error"))


@query(f"""with {OPS}, n as (select doc_id, max(page) as n from ops group by doc_id)
select doc_id, null::int as page, 'invalid_degrees' as error, null::int as rotation from n where doc_id % 5 = 4 union all
select doc_id, unnest(range(1, n + 1))::int as page, null as error, case when unnest(range(1, n + 1)) = n then (((doc_id % 7 - 3) * 90 % 360) + 360) % 360 else 0 end::int as rotation from n where doc_id % 5 <> 4""")
def pdf_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's last page turned, and the rotations of all its pages."""
    degrees = F.when(F.col("doc_id") % 5 == 4, 45).otherwise((F.col("doc_id") % 7 - 3) * 90).cast("int")
    turned = documents(spark, sf_dir).select("doc_id", E.rotate_page(F.col("content"), E.page_count(F.col("content")).value, degrees).alias("r"))
    parsed = from_binary(turned.select(F.struct("doc_id", F.col("r.error").alias("error")).alias("own"), F.col("r.value").alias("content")), id="own", want=())
    pages = parsed.select("doc_id.doc_id", "doc_id.error", F.explode_outer("pages").alias("p"))
    return pages.select("doc_id", "p.page", "error", "p.rotation")


@query(f"with {OPS}, n as (select doc_id, page, count(*) as n from ops group by all), p as (select doc_id, max(page) as last from ops group by doc_id), every_page as (select doc_id, unnest(range(1, last + 1)) as page from p) select doc_id, page::int as page, (coalesce(n, 0) + 1)::bigint as runs, 'SAMPLE' as last_text from every_page left join n using (doc_id, page)")
def pdf_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = documents(spark, sf_dir).select("doc_id", E.watermark(F.col("content"), F.lit("SAMPLE")).value.alias("content"))
    runs = parsed_tables(from_binary(marked, want=("runs",)))["runs"]
    return runs.groupBy("doc_id", "page").agg(F.count("*").alias("runs"), F.max_by("text", "run_ix").alias("last_text"))


@query(f"with {OPS}, n as (select doc_id, max(page) as n from ops group by doc_id) select doc_id, unnest(range(1, n + 1))::int as page, 102::int as width, 132::int as height, '89504e470d0a1a0a' as signature from n")
def png_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of every page."""
    pages = documents(spark, sf_dir).select("doc_id", "content", F.explode(F.sequence(F.lit(1), E.page_count(F.col("content")).value)).alias("page"))
    drawn = pages.select("doc_id", "page", RD.render(F.col("content"), F.col("page"), width=102).alias("i"))
    return drawn.select("doc_id", "page", "i.width", "i.height", F.lower(F.hex(F.substring("i.png", 1, 8))).alias("signature"))


@query(f"with {OPS} select distinct doc_id, case when doc_id % 3 = 0 then 'malformed_pdf' when doc_id % 3 = 1 then 'not_a_pdf' end as code from ops")
def pdf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged documents are rows with a code."""
    from ..sources.pdf import validate

    broken = F.when(F.col("doc_id") % 3 == 0, F.substring("content", 1, 12)).when(F.col("doc_id") % 3 == 1, F.substring("content", 10, 100)).otherwise(F.col("content"))
    docs = documents(spark, sf_dir).select("doc_id", broken.alias("content"))
    early = validate(docs).select(F.struct("doc_id", F.col("error.code").alias("early")).alias("own"), "content")
    return from_binary(early, id="own", want=()).select("doc_id.doc_id", F.coalesce("doc_id.early", "error.code").alias("code"))

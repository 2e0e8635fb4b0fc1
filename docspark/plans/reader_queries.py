"""What readers tell of documents: fonts, outlines, links, tags, forms, passwords, pixels; and whole documents chunked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chunks as C, edit as E, render as RD, tagged as TG
from ..operators.runs import synthetic_runs, text_lines
from ..pdf.image import decode_png
from ..pdf.writer import Builder
from ..sources.pdf import from_binary, parsed_tables
from . import made as M
from .registry import LINES, TOKENS, packed, query, table


def ops_sql(dropped: str) -> str:
    text = f"trim(regexp_replace(line, '{dropped}', '', 'g'), ' ')"
    return f"{LINES}, ops as (select doc_id, line_no, line_no // 40 + 1 as page, {text} as text, 740 - 18 * (line_no % 40) as y from lines where {text} <> '')"


OPS = ops_sql(M.LATIN)
LAST = "last as (select doc_id, max(page) as n from ops group by doc_id)"
PAGES = f"{LAST}, pages as (select doc_id, n, unnest(range(1, n + 1)) as p from last)"


@query(f"with {OPS} select doc_id, page::int as page, text, y::double as y from ops")
def pdf_latin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text beyond ASCII, written by our writer in a declared encoding and read back."""
    n = F.col("line_no")
    text = F.trim(F.regexp_replace("line", M.LATIN, ""))
    rows = text_lines(table(spark, sf_dir, "documents")).select("doc_id", (F.floor(n / 40) + 1).cast("int").alias("page"), n.cast("int").alias("op_ix"), text.alias("text"), F.lit(72.0).alias("x"), (740 - 18.0 * (n % 40)).alias("y"), F.lit(11.0).alias("size"), F.lit("Times-Roman").alias("font"))
    runs = parsed_tables(from_binary(E.build(rows.where("text <> ''")), want=("runs",)))["runs"]
    return runs.select("doc_id", "page", "text", F.round("y0", 3).alias("y"))


@query(f"""with {ops_sql(M.BMP)}, n as (select *, length(text) as chars, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) as narrow from ops)
select doc_id, page::int as page, text, round(72 + 11 * (0.25 * narrow + 0.6 * (chars - narrow)), 3)::double as x1 from n""")
def pdf_cid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-byte codes: text by a ToUnicode stream, extent by the widths of ranges and the default width."""
    runs = parsed_tables(from_binary(M.documents(spark, sf_dir, M.cid_font, M.BMP), want=("runs",)))["runs"]
    return runs.select("doc_id", "page", "text", F.round("x1", 3).alias("x1"))


@query(f"""with {OPS}, {PAGES}, heads as (select doc_id, page as p, arg_min(text, line_no)[:20] as title from ops group by doc_id, page)
select doc_id, (p - 1)::int as node_ix, case when p % 2 = 1 then -1 else p - 2 end::int as parent_ix, (1 - p % 2)::int as depth, case when p % 2 = 1 then (p - 1) // 2 else 0 end::int as ordinal, coalesce(title, 'Empty') as title, p::int as page
from pages left join heads using (doc_id, p)""")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline trees whose destinations are arrays, names of the old kind, and names in a tree."""
    return parsed_tables(from_binary(M.documents(spark, sf_dir, M.outlined), want=("outline",)))["outline"]


@query(f"""with {OPS}, {PAGES}, lines_n as (select doc_id, count(*) as c from ops group by doc_id)
select doc_id, p::int as page, case when p % 2 = 0 then 300 + p else 612 end::double as w_pt, case when p % 2 = 0 then 400 + c else 792 end::double as h_pt, case when p % 3 = 0 then 90 * p % 360 else 0 end::int as rotation from pages join lines_n using (doc_id)""")
def pdf_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages, their own and inherited ones, and rotations."""
    return parsed_tables(from_binary(M.documents(spark, sf_dir, M.sized), want=()))["pages"].select("doc_id", "page", "w_pt", "h_pt", "rotation")


@query(f"""with {OPS}, {PAGES}
select doc_id, p::int as page, 0::int as link_ix, 50.0::double as x0, 700.0::double as y0, 150.0::double as x1, 720.0::double as y1, 'uri' as kind, 'https://example.com/é/' || p as uri, null::int as target_page from pages
union all select doc_id, p::int, 1::int, 200.0, 700.0, (300 + p)::double, 720.0, 'page', null, (p % n + 1)::int from pages""")
def pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and links within documents; a link that leads nowhere is none."""
    return parsed_tables(from_binary(M.documents(spark, sf_dir, M.linked), want=("links",)))["links"]


TAGGED = f"""{OPS}, nodes as (
  select *, row_number() over (partition by doc_id order by line_no) as k, count(*) over (partition by doc_id) as n,
    case when line_no % 17 = 0 then 'Chapter' when line_no % 7 = 3 then 'Figure' else 'P' end as raw from ops)"""


@query(f"""with {TAGGED}, every_node as (
  select doc_id, (k + 1)::int as node_ix, 1 as parent_ix, 2 as depth, (k + 1)::int as last_ix, case when raw = 'Chapter' then 'H1' else raw end as tag, raw as raw_tag, case when raw = 'Figure' then 'Bild № ' || line_no end as alt, page::int as page, text as own_text from nodes
  union all select distinct doc_id, 0, -1, 0, (n + 1)::int, 'Root', 'Root', null, null::int, '' from nodes
  union all select distinct doc_id, 1, 0, 1, (n + 1)::int, 'Document', 'Document', null, null::int, '' from nodes)
select doc_id, node_ix, parent_ix::int as parent_ix, depth::int as depth, last_ix, tag, raw_tag, alt, page, own_text from every_node""")
def pdf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of tagged documents with their roles resolved and the text of their marked content."""
    parts = parsed_tables(from_binary(M.documents(spark, sf_dir, M.tagged), want=("runs", "structure")))
    return TG.node_text(parts["nodes"], parts["kids"], parts["runs"]).select("doc_id", "node_ix", "parent_ix", "depth", "last_ix", "tag", "raw_tag", "alt", "page", "own_text")


@query(f"""with {TAGGED} select doc_id, count(*) filter (raw = 'Chapter') as headings, count(*) filter (raw = 'Figure') as figures, count(distinct case when raw = 'P' then text end) > 0 as has_text,
  sum(case when raw = 'Figure' then length('Bild № ' || line_no) else length(text) end)::bigint as chars from nodes group by doc_id""")
def chunk_tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged documents chunked whole: a chunk for each heading and figure, and no character of text lost or told twice."""
    made = C.chunk_parsed(from_binary(M.documents(spark, sf_dir, M.tagged)), target_tokens=1)
    kinds = lambda k: F.count_if(F.col("kind") == k)
    return made.groupBy("doc_id").agg(kinds("Heading").alias("headings"), kinds("Figure").alias("figures"), (kinds("Paragraph") > 0).alias("has_text"), F.sum(F.length("text")).cast("bigint").alias("chars"))


#: Documents whose lines are what a base font writes.
PLAIN = "docs0 as (select doc_id, regexp_replace(text, '[^ -~\\n]', '', 'g') as text from documents)"


@query(f"with recursive {PLAIN}, {packed(512).replace('from documents', 'from docs0')}, offsets as (select *, length(text) as char_len, coalesce(sum(length(text) + 2) over (partition by doc_id order by chunk_ix rows between unbounded preceding and 1 preceding), 0)::bigint as char_start from chunks) "
       f"select doc_id, chunk_ix, page::int as page, kind, sha256(text) as text_sha256, array_to_string(path, ' > ') as heading_path, char_start, char_len, {TOKENS.format('text')} as token_estimate from offsets")
def chunk_pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as PDF, read and chunked whole, each in its own row."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "[^ -~\\n]", ""))
    runs = synthetic_runs(docs)
    ops = runs.select("doc_id", "page", F.col("run_ix").cast("int").alias("op_ix"), "text", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("font_size").alias("size"), F.lit("Helvetica").alias("font"))
    made = C.chunk_parsed(from_binary(E.build(ops)))
    return made.select("doc_id", "chunk_ix", "page", "kind", F.sha2("text", 256).alias("text_sha256"), F.array_join("heading_path", " > ").alias("heading_path"), "char_start", "char_len", "token_estimate")


@query("""with f as (select s_suppkey, s_nationkey, unnest(['field' || (s_suppkey % 10), 'field' || (s_suppkey % 3), 'name']) as name, generate_subscripts([1, 2, 3], 1) as k, s_name from supplier)
select s_suppkey, k::int as field, name, case when name = 'name' then s_name when name = 'field' || n_regionkey then n_name else '' end as value from f join nation on n_nationkey = s_nationkey""")
def form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms filled by field name and read back; names that a form lacks are passed over, other fields stay empty."""

    def of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([M.form([f"field{k % 10}", f"field{k % 3}", "name"]) for k in b.column(0).to_pylist()], pa.binary()), *b.columns[1:]], names=["doc_id", "content", "s_name", "key"])

    forms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("doc_id"), "s_name", F.col("s_nationkey").cast("bigint").alias("key")).mapInArrow(of, "doc_id bigint, content binary, s_name string, key bigint")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.concat(F.lit("field"), F.col("n_regionkey").cast("string")).alias("name"), F.col("n_name").alias("value"))
    known = forms.join(nation, "key")
    filled = known.select("doc_id", E.fill_form(F.col("content"), F.create_map(F.lit("name"), F.col("s_name"), F.col("name"), F.col("value"), F.lit("absent"), F.lit("x"))).value.alias("content"))
    fields = from_binary(filled, want=("form",)).select("doc_id", F.posexplode("form").alias("k", "f"))
    return fields.select(F.col("doc_id").alias("s_suppkey"), (F.col("k") + 1).alias("field"), "f.name", "f.value")


@query(f"""with {OPS}, {PAGES} select pages.doc_id, ((p + 1) // 2)::int as page, ((n + 1) // 2)::int as page_count, min_by(text, line_no) as first_text from pages left join ops on ops.doc_id = pages.doc_id and ops.page = p where p % 2 = 1 group by pages.doc_id, p, n""")
def pdf_remove_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page taken out; the others keep their order and text."""
    docs = M.documents(spark, sf_dir, M.linked).withColumn("n", E.page_count(F.col("content")).value)
    even = F.filter(F.sequence(F.lit(1), F.col("n")), lambda p: p % 2 == 0)
    left = from_binary(docs.select("doc_id", E.remove_pages(F.col("content"), even).value.alias("content")), want=("runs",))
    first = F.min_by("r.text", "r.run_ix")
    pages = left.select("doc_id", "meta.page_count", F.explode("pages.page").alias("page"), "runs")
    runs = pages.select("doc_id", "page", "page_count", F.explode_outer(F.filter("runs", lambda r: r.page == F.col("page"))).alias("r"))
    return runs.groupBy("doc_id", "page", "page_count").agg(first.alias("first_text"))


@query(f"with {OPS}, {LAST} select doc_id, n::int as entries, '504b0304' as signature, case when n = 1 then 'part-000.pdf' else 'part-' || lpad((n - 1)::varchar, 3, '0') || '.pdf' end as last_name from last")
def pdf_zip_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip of each document's pages, its directory read natively: the count of entries and the last one's name."""
    docs = M.documents(spark, sf_dir, M.linked).withColumn("n", E.page_count(F.col("content")).value)
    ranges = F.transform(F.sequence(F.lit(1), F.col("n")), lambda p: F.array(p, p))
    z = E.zip_parts(E.split(F.col("content"), ranges).value).value
    zipped = docs.select("doc_id", z.alias("z"))
    size = F.octet_length("z")
    little = lambda at: F.conv(F.concat(F.hex(F.substring("z", at + 1, 1)), F.hex(F.substring("z", at, 1))), 16, 10).cast("int")
    name = F.substring("z", size - 22 - 12 + 1, 12).cast("string")
    return zipped.select("doc_id", little(size - 22 + 11).alias("entries"), F.lower(F.hex(F.substring("z", 1, 4))).alias("signature"), name.alias("last_name"))


@query(f"""with {OPS}, {LAST} select doc_id, case when doc_id % 4 in (0, 3) then n end::int as page_count, case when doc_id % 4 in (1, 2) then 'password_required_or_incorrect' end as code, doc_id % 4 in (0, 3) as encrypted from last""")
def pdf_passwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted documents, each with its own password: the user's, a wrong one, none, the owner's."""
    own = F.get(F.array(F.lit("open"), F.lit("wrong"), F.lit(None).cast("string"), F.lit("owner")), (F.col("doc_id") % 4).cast("int"))
    parsed = from_binary(M.documents(spark, sf_dir, M.locked).withColumn("own", own), passwords="own", want=())
    return parsed.select("doc_id", "meta.page_count", F.col("error.code").alias("code"), F.coalesce("meta.encrypted", F.lit(False)).alias("encrypted"))


@query("select doc_id, 34::int as width, 44::int as height, (doc_id % 256)::int as left_gray, ((doc_id * 7) % 256)::int as right_gray from documents")
def rendered_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are an image of two halves, rendered, and the middle pixel of each half read from the PNG."""

    def make(batches):
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                d = Builder()
                d.add_page()
                d.place_samples(0, bytes([k % 256, k * 7 % 256]), 2, 1, "DeviceGray", (0, 0, 612, 792))
                out.append(d.save())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    def halves(png: pa.Array) -> pa.Array:
        drawn = [np.asarray(decode_png(x)) for x in png.to_pylist()]
        return pa.array([[int(a[22, 8].flat[0]), int(a[22, 25].flat[0])] for a in drawn], pa.list_(pa.int32()))

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint")).mapInArrow(make, "doc_id bigint, content binary")
    shown = docs.select("doc_id", RD.render(F.col("content"), F.lit(1), width=34).alias("i"))
    told = shown.select("doc_id", "i.width", "i.height", F.arrow_udf(halves, "array<int>")(F.col("i.png")).alias("h"))
    return told.select("doc_id", "width", "height", F.col("h")[0].alias("left_gray"), F.col("h")[1].alias("right_gray"))

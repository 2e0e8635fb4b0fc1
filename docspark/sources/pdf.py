"""PDF documents as tables: one parse for each document inside a task, then plain DataFrames.

A document that cannot be read is a row with an error (code, message); no document fails a job, but a worker that runs
out of memory fails its task, as the document may be sound. Files are read by Spark's binary reader, so any file system
that Spark reaches will do.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import is_pdf
from ..pdf.document import PARTS, parse
from ..pdf.errors import PdfError

ERROR = "struct<code:string,message:string>"
META = "struct<title:string,author:string,subject:string,keywords:string,creator:string,producer:string,creation_date:string,mod_date:string,page_count:int,pdf_version:string,encrypted:boolean>"
NESTED = {
    "pages": "page:int,w_pt:double,h_pt:double,rotation:int,error:string",
    "runs": "page:int,run_ix:bigint,text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,mcid:bigint",
    "draws": "page:int,draw_ix:int,obj_id:string,a:double,b:double,c:double,d:double,e:double,f:double",
    "rules": "page:int,line_ix:int,vertical:boolean,pos:double,lo:double,hi:double",
    "links": "page:int,link_ix:int,x0:double,y0:double,x1:double,y1:double,kind:string,uri:string,target_page:int",
    "outline": "node_ix:int,parent_ix:int,depth:int,ordinal:int,title:string,page:int",
    "nodes": "node_ix:int,parent_ix:int,depth:int,last_ix:int,tag:string,raw_tag:string,alt:string,page:int,col_span:int,row_span:int",
    "kids": "node_ix:int,kid_ix:int,page:int,mcid:bigint",
    "form": "name:string,value:string",
}
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


#: Bytes of documents and of what is read from them, as estimated, that a result batch gathers.
OUT_BYTES = 4 << 20


def _arrow(fields: str) -> pa.StructType:
    return pa.struct([(n, _TYPES[t]) for n, t in (f.split(":") for f in fields.split(","))])


_META_ARROW = _arrow(META.removeprefix("struct<").removesuffix(">"))
_ERROR_ARROW = pa.struct([("code", pa.string()), ("message", pa.string())])


def from_binary(docs: DataFrame, *, id: str = "doc_id", content: str = "content", password: str | None = None, passwords: str | None = None, pages: list[int] | None = None, max_pages: int | None = None, want: tuple[str, ...] = PARTS) -> DataFrame:
    """One nested row for each document: doc_id, error, meta, tagged, and an array for each part wanted.

    passwords names a column with each document's own password; password is one for all."""
    kind = docs.schema[id].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id].dataType)
    schema = f"doc_id {kind}, error {ERROR}, meta {META}, tagged boolean, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in NESTED.items())
    arrow = [id_type, _ERROR_ARROW, _META_ARROW, pa.bool_(), *(pa.list_(_arrow(v)) for v in NESTED.values())]
    names = ["doc_id", "error", "meta", "tagged", *NESTED]

    def of(batches):
        rows: list[list] = []
        size = 0
        for b in batches:
            for doc, data, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                error, got, content = None, {}, data.as_py() or b""
                try:
                    got = parse(content, own if own is not None else password, pages=pages, max_pages=max_pages, want=want)
                except PdfError as e:
                    error = {"code": e.code, "message": e.message}
                except MemoryError:  # tells of the worker: with a row for it, a sound document's runs would be gone without a word
                    raise
                except Exception as e:  # one broken document is a row, not a failed job
                    error = {"code": "internal", "message": f"{type(e).__name__}: {e}"[:300]}
                rows.append([doc, error, got.get("meta"), got.get("tagged"), *(got.get(k) for k in NESTED)])
                size += len(content) + 200 * sum(len(got.get(k) or ()) for k in NESTED)
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

    own = F.col(passwords) if passwords else F.lit(None).cast("string")
    return docs.select(F.col(id).alias("doc_id"), F.col(content).alias("content"), own.alias("password")).mapInArrow(of, schema)


def read_pdfs(spark: SparkSession, path: str, *, glob: str = "*.pdf", **options) -> DataFrame:
    """Documents below a path, named by their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return from_binary(files.select(F.col("path").alias("doc_id"), "content"), **options)


def read_pdfs_stream(spark: SparkSession, path: str, *, glob: str = "*.pdf", **options) -> DataFrame:
    """The same as a stream: new files are parsed as they come. An extension."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return from_binary(files.select(F.col("path").alias("doc_id"), "content"), **options)


def validate(docs: DataFrame, *, content: str = "content") -> DataFrame:
    """docs with error not_a_pdf where no signature stands among the first 1024 bytes. Native."""
    bad = F.struct(F.lit("not_a_pdf").alias("code"), F.lit("no PDF signature").alias("message"))
    return docs.withColumn("error", F.when(~F.coalesce(is_pdf(F.col(content)), F.lit(False)), bad))


def parsed_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Flat tables out of nested rows; write the nested rows first if more than one of them is used."""
    out = {k: parsed.select("doc_id", F.explode(k).alias("x")).select("doc_id", "x.*") for k in NESTED}
    out["doc_meta"] = parsed.where("meta is not null").select("doc_id", "meta.*", "tagged")
    out["errors"] = parsed.where("error is not null").select("doc_id", "error.code", "error.message")
    return out


def register_data_source(spark: SparkSession) -> None:
    """spark.read.format("docspark_pdf").load(path): runs of the documents of a folder that every worker sees; a broken one is a row with an error."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.path = options["path"].removeprefix("file://")

        def partitions(self) -> list[InputPartition]:
            import glob

            return [InputPartition(p) for p in sorted(glob.glob(f"{self.path}/**/*.pdf", recursive=True))]

        def read(self, partition: InputPartition):
            with open(partition.value, "rb") as f:
                data = f.read()
            try:
                for r in parse(data, want=("runs",))["runs"]:
                    yield (partition.value, *(r[k] for k in ("page", "run_ix", "text", "x0", "y0", "x1", "y1", "font_size", "mcid")), None)
            except PdfError as e:
                yield (partition.value, *[None] * 8, e.code)
            except Exception:  # one broken document is a row, not a failed job
                yield (partition.value, *[None] * 8, "internal")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "docspark_pdf"

        def schema(self) -> str:
            return "doc_id string, " + NESTED["runs"].replace(":", " ").replace(",", ", ") + ", error string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(Source)

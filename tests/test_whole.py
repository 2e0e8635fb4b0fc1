"""Queries against their SQL on documents that the given tables do not hold."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from docspark.operators import extract as EX
from tests.test_queries import plain


def is_its_sql(spark, folder, name: str, texts: list[str | None], ids: list[int] | None = None) -> list[tuple]:
    """The query's rows on these documents, once they are those of its SQL."""
    rows = {"doc_id": pa.array(ids or range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(rows), folder / "documents.parquet")
    made = entry.queries()[name](spark, str(folder))
    columns = sorted(made.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in made.collect()), key=repr)
    c = duckdb.connect()
    c.execute(f"create view documents as from '{folder}/documents.parquet'")
    found = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(x)]) for x in columns) for r in found.fetchall()), key=repr)
    assert got == want and got
    return got


def test_extract_auto_has_every_page(spark, tmp_path):
    """More than 20 pages, more than 200 000 characters, more images than the pixel budget, and a page without a line."""
    texts = ["\n".join(f"line {i} of a long text" for i in range(1000)), "\n".join("x" * 999 for _ in range(300)), "\n".join("ab" for _ in range(130)), "first" + "\n" * 95 + "third", None, ""]
    got = is_its_sql(spark, tmp_path, "extract_auto", texts)
    assert [(r[0], r[2]) for r in got] == [(0, 25), (1, 8), (2, 4), (3, 2)] and got[2][1] == "1,2,3,4" and got[3][1] == "1,3"


@pytest.mark.parametrize("case", [[], ["", ""], ["", "a", "", "b"], ["\na", "b"], ["a"]])
def test_join_without_a_cap(spark, case):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(case,)], "t array<string>").select(EX.join_capped(F.col("t"), None).alias("a"), EX.join_capped(F.col("t"), 100).alias("b")).first()
    assert row.a == row.b


@pytest.mark.parametrize("seed", [50065138, 60114698])
def test_latin_runs_of_documents_whose_bytes_spell_widths(spark, tmp_path, seed):
    """Compressed, a stream of either document holds /W[ by chance near the cross-reference stream."""
    r = random.Random(seed)
    lines = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz éüÄß", k=90)).strip() for _ in range(5)]
    assert len(is_its_sql(spark, tmp_path, "pdf_latin_runs", [("\n" * 40).join(lines)])) == 5


def test_no_document_is_lost_where_memory_is_short(spark, monkeypatch):
    """A worker's lack of memory fails the task; it is no error of the document, whose runs would be missing."""
    from docspark.sources import pdf

    def short(*args, **options):
        raise MemoryError

    monkeypatch.setattr(pdf, "parse", short)
    docs = spark.createDataFrame([(1, bytearray(b"%PDF-1.7"))], "doc_id bigint, content binary")
    with pytest.raises(Exception, match="MemoryError"):
        pdf.parsed_tables(pdf.from_binary(docs, want=("runs",)))["runs"].collect()


def test_a_long_string_is_decoded_without_an_item_for_each_byte():
    import tracemalloc

    from docspark.pdf.document import Document
    from docspark.pdf.fonts import Font
    from docspark.pdf.objects import Name
    from docspark.pdf.writer import Builder

    b = Builder()
    b.add_page()
    font = Font(Document(b.save()).file, {"Subtype": Name("Type1"), "Encoding": Name("WinAnsiEncoding")})
    text = "aé(ÿ" * 250_000
    raw = text.encode("cp1252")
    tracemalloc.start()
    got = font.text(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == text and peak < 6 * len(raw)


def test_tagged_tables_of_nested_nodes(spark):
    """Nodes held in an array give the tables of flat ones: rows in wrappers and in rows, spans, and documents without a table."""
    from docspark.operators import tagged as TG

    node = "struct<node_ix:int,parent_ix:int,last_ix:int,tag:string,full_text:string,box:array<double>,col_span:int,row_span:int>"
    tree = [
        (0, -1, 9, "Table", "", None, None, None), (1, 0, 9, "TBody", "", None, None, None), (2, 1, 4, "TR", "", None, None, None), (3, 2, 3, "TH", "a", [1.0, 2.0, 3.0, 4.0], None, 2), (4, 2, 4, "TH", "b", None, 1, 1),
        (5, 1, 9, "TR", "", None, None, None), (6, 5, 9, "TD", "c", None, 2, None), (7, 6, 9, "TR", "", None, None, None), (8, 7, 8, "TD", "inner", None, None, None), (9, 7, 9, "TD", "x", None, None, None),
        (10, -1, 11, "Table", "", None, None, None), (11, 10, 11, "P", "no row", None, None, None),
    ]
    docs = spark.createDataFrame([(1, tree), (2, []), (3, None), (4, tree[:5])], f"doc_id bigint, nodes array<{node}>")
    flat = TG.tagged_tables(docs.selectExpr("doc_id", "inline(nodes)")).collect()
    held = TG.tagged_tables_in(docs).collect()
    assert sorted(map(str, flat)) == sorted(map(str, held)) and sorted((r.doc_id, r.node_ix) for r in held) == [(1, 0), (4, 0)]


def test_tagged_grid_is_its_sql_on_odd_rows(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 3, 4, 12, 13, 15, 16, 700)] + [None, " \n ", "ä\tb\r\nc  d e"]
    is_its_sql(spark, tmp_path, "tagged_grid", texts)


def test_batches_are_cut_between_rows(monkeypatch):
    from docspark.operators import grouped as G

    monkeypatch.setattr(G, "IN_ITEMS", 3)
    b = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5, 6], "a": pa.array([[1, 2], [3], [4, 5, 6, 7], None, [], [8]], pa.list_(pa.int64()))})
    parts = list(G._parts(b))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2], [3, 4, 5], [6]]
    assert [p.column(1).flatten().to_pylist() for p in parts] == [[1, 2, 3], [4, 5, 6, 7], [8]]

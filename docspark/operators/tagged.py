"""Logical structure: nodes in preorder, their content by marked-content id, their blocks.

struct_nodes: doc_id, node_ix (preorder), parent_ix, depth, last_ix (the last descendant), tag, raw_tag, alt, page,
col_span, row_span. A descendant of n has a node_ix in (n.node_ix, n.last_ix].
struct_kids: doc_id, node_ix, kid_ix, page, mcid.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema
from ..core import tables as core
from ..core.blocks import union
from .grouped import in_rows, of_groups

#: What a tag stands for in blocks; other tags only hold others.
PARAGRAPH_TAGS = ("P", "Formula", "BlockQuote", "Quote", "Note", "Reference", "BibEntry")
MAX_ROLE_HOPS = 16
NO_FIGURE_TEXT = "[figure]"
CELL_COLUMNS = ["node_ix", "parent_ix", "last_ix", "tag", "full_text", "box", "col_span", "row_span"]


def resolve_roles(roles: DataFrame) -> DataFrame:
    """(doc_id, raw, tag): the end of each RoleMap chain (doc_id, raw, target), 16 hops at most, safe for cycles.

    A document's map is gathered once and each chain is a fold over it; of targets of one name the least counts."""
    own = roles.groupBy("doc_id", "raw").agg(F.min("target").alias("target")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("raw", "target"))).alias("m"))

    def hop(now: Column, _: Column) -> Column:
        following = F.try_element_at(F.col("m"), now.tag)
        go = following.isNotNull() & ~F.array_contains(now.seen, now.tag)
        return F.struct(F.when(go, following).otherwise(now.tag).alias("tag"), F.when(go, F.array_append(now.seen, now.tag)).otherwise(now.seen).alias("seen"))

    chains = own.select("doc_id", "m", F.explode("m").alias("raw", "target"))
    end = F.aggregate(F.sequence(F.lit(2), F.lit(MAX_ROLE_HOPS)), F.struct(F.col("target").alias("tag"), F.array("raw").alias("seen")), hop, lambda x: x.tag)
    return chains.select("doc_id", "raw", end.alias("tag"))


def mcid_content(runs: DataFrame) -> DataFrame:
    """(doc_id, page, mcid, text, x0, y0, x1, y1): runs of each marked-content id, joined in content order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ix", "text"))), lambda x: x.text), "")
    return runs.where("mcid is not null").groupBy("doc_id", "page", "mcid").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def node_text(nodes: DataFrame, kids: DataFrame, runs: DataFrame) -> DataFrame:
    """nodes with own_text and own_box: an equi-join of their kids with the marked content."""
    found = kids.join(mcid_content(runs), ["doc_id", "page", "mcid"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kid_ix", "text"))), lambda x: x.text), "")
    box = F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    own = found.groupBy("doc_id", "node_ix").agg(text.alias("own_text"), box.alias("own_box"))
    return nodes.join(own, ["doc_id", "node_ix"], "left").withColumn("own_text", F.coalesce("own_text", F.lit("")))


def subtree(nodes: DataFrame) -> DataFrame:
    """nodes with full_text (own and descendants' texts that are not empty, by line) and box (all of theirs).

    A pass over each document's nodes in preorder: a subtree is a slice, so nothing is paired."""
    doc_ddl = nodes.schema["doc_id"].dataType.simpleString()

    def of(key: tuple, cols: list[list]):
        ix, last, texts, boxes = cols
        said = [k for k, t in enumerate(texts) if t]
        held = [None if b is None else [b["x0"], b["y0"], b["x1"], b["y1"]] for b in boxes]
        ends = [bisect_right(ix, n) for n in last]
        for k in range(len(ix) - 1, -1, -1):  # a node's children come after it, so their boxes are whole already
            child = k + 1
            while child < ends[k]:
                held[k] = union(held[k], held[child])
                child = ends[child]
        for k, end in enumerate(ends):
            own = said[bisect_left(said, k) : bisect_left(said, end)]
            yield (*key, ix[k], "\n".join(texts[m] for m in own), held[k])

    rolled = of_groups(nodes, ["doc_id"], ["node_ix"], ["node_ix", "last_ix", "own_text", "own_box"], of, f"doc_id {doc_ddl}, node_ix int, full_text string, box array<double>")
    return nodes.join(rolled, ["doc_id", "node_ix"])


def tag_kind(tag: Column) -> Column:
    """The kind of block a tag makes, or null."""
    heading = tag.rlike("^H[1-6]?$")
    return F.when(heading, "Heading").when(tag.isin(*PARAGRAPH_TAGS), "Paragraph").when(tag == "L", "List").when(tag.isin("Table", "Figure", "Caption"), tag)


def heading_level(tag: Column) -> Column:
    return F.when(tag == "H", 1).otherwise(F.try_element_at(F.split(tag, "H"), F.lit(2)).cast("int"))


def tagged_blocks(nodes: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """Blocks of a tagged document: the outermost nodes that make a block, in order.

    nodes as from subtree; a node below another that makes a block belongs to that one (an anti-join on intervals).
    A missing page is the last one seen."""
    w = Window.partitionBy("doc_id").orderBy("node_ix")
    kinds = nodes.withColumns({"kind": tag_kind(F.col("tag")), "page_": F.coalesce(F.last("page", ignorenulls=True).over(w), F.lit(1))})
    made = kinds.where("kind is not null")
    covered = F.max("last_ix").over(w.rowsBetween(Window.unboundedPreceding, -1))
    outer = made.withColumn("_covered", F.coalesce(covered, F.lit(-1))).where("node_ix > _covered")
    text = F.when(F.col("kind") == "Figure", F.coalesce(F.nullif("alt", F.lit("")), F.nullif("full_text", F.lit("")), F.lit(NO_FIGURE_TEXT))).otherwise(F.col("full_text"))
    size = F.when(F.col("kind") == "Heading", 7 - heading_level(F.col("tag"))).otherwise(0).cast("double")
    out = outer.withColumn("text", text).where((F.col("text") != "") | (F.col("kind") == "Table"))
    out = out.select("doc_id", (F.row_number().over(w) - 1).cast("int").alias("block_ix"), F.col("page_").cast("int").alias("page"), "kind", "text", F.col("box").alias("bbox"), size.alias("size"), F.lit(0).alias("column"), "node_ix")
    if grids is not None:
        return out.join(grids, ["doc_id", "node_ix"], "left").drop("node_ix")
    return out.withColumn("table", F.lit(None).cast(schema.TABLE)).drop("node_ix")


def _tables(cols: list[list]) -> Iterator[tuple[int, dict]]:
    """(node_ix, table) of each Table node among one document's nodes in preorder, given by column."""
    ix, parents, lasts, tags, texts, boxes, col_spans, row_spans = cols
    for k, tag in enumerate(tags):
        if tag != "Table":
            continue
        stop, m = bisect_right(ix, lasts[k]), k + 1
        by_row = []
        while m < stop:
            if tags[m] != "TR":
                m += 1
                continue
            own, end = ix[m], min(bisect_right(ix, lasts[m]), stop)
            by_row.append([{"tag": tags[j], "text": texts[j], "bbox": boxes[j], "col_span": col_spans[j] or 1, "row_span": row_spans[j] or 1} for j in range(m + 1, end) if parents[j] == own and (tags[j] == "TD" or tags[j] == "TH")])
            m = max(m + 1, end)  # a row inside a row is no row of the table
        if by_row and (table := core.tagged_table(by_row)):
            yield ix[k], table


def tagged_tables(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_ix, table): the grid of each Table node, from its rows below any wrapper and their TH and TD."""
    doc_ddl = nodes.schema["doc_id"].dataType.simpleString()

    def of(key: tuple, cols: list[list]):
        for made in _tables(cols):
            yield (*key, *made)

    taken = nodes.where("tag in ('Table', 'TR', 'TH', 'TD')")
    return of_groups(taken, ["doc_id"], ["node_ix"], CELL_COLUMNS, of, f"doc_id {doc_ddl}, node_ix int, table {schema.TABLE}")


def tagged_tables_in(docs: DataFrame) -> DataFrame:
    """tagged_tables of documents that hold their nodes (doc_id, nodes: an array in preorder with CELL_COLUMNS): nothing is shuffled or sorted.

    A document may come in several rows, if none parts a table."""
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node_ix int, table {schema.TABLE}"
    return in_rows(docs, "nodes", CELL_COLUMNS, _tables, ddl)

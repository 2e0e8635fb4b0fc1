"""Images on pages, the captions they adopt, and ruled lattices over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema
from ..core import tables as core
from ..core.blocks import CAPTION_REACH
from ..functions.geometry import image_bbox
from ..functions.text import is_caption
from .grouped import of_groups
from .layout import id_type


def image_boxes(draws: DataFrame) -> DataFrame:
    """(doc_id, page, fig_ix, x0, y0, x1, y1) of each image drawn, in draw order."""
    box = image_bbox({c: F.col(c) for c in "abcdef"})
    return draws.select("doc_id", "page", F.col("draw_ix").alias("fig_ix"), box.alias("b")).select("doc_id", "page", "fig_ix", "b.*")


def image_regions(draws: DataFrame, lines: DataFrame) -> DataFrame:
    """image_boxes with caption: the nearest caption line below that overlaps, else the nearest above.

    A nearest range join: only caption lines take part, joined by page, the nearest kept by an aggregation."""
    figures = image_boxes(draws)
    heads = lines.where(is_caption(F.col("text"))).select("doc_id", "page", "line_ix", F.col("text").alias("caption"), "y", F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), (CAPTION_REACH * F.greatest("size", F.lit(1.0))).alias("reach"))
    pairs = figures.join(heads, ["doc_id", "page"]).where(F.least("lx1", "x1") > F.greatest("lx0", "x0"))
    below = (F.col("y") <= F.col("y0")) & (F.col("y") >= F.col("y0") - F.col("reach"))
    above = (F.col("y") >= F.col("y1")) & (F.col("y") <= F.col("y1") + F.col("reach"))
    ranked = pairs.select("doc_id", "page", "fig_ix", "caption", F.when(below, F.struct(F.lit(0).alias("side"), (F.col("y0") - F.col("y")).alias("d"), "line_ix")).when(above, F.struct(F.lit(1).alias("side"), (F.col("y") - F.col("y1")).alias("d"), "line_ix")).alias("rank"))
    best = ranked.where("rank is not null").groupBy("doc_id", "page", "fig_ix").agg(F.min_by("caption", "rank").alias("caption"))
    return figures.join(best, ["doc_id", "page", "fig_ix"], "left")


def adopted_captions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """blocks without the captions that a figure of the page has adopted."""
    taken = regions.where("caption is not null").select("doc_id", "page", F.col("caption").alias("text"), F.lit("Caption").alias("kind")).distinct()
    return blocks.join(taken, ["doc_id", "page", "kind", "text"], "left_anti")


def figure_columns(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """regions with column: that whose extent holds the figure's center, else the nearest; the first of ties; 0 without text."""
    extent = lines.groupBy("doc_id", "page", "column").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    center = (F.col("x0") + F.col("x1")) / 2
    away = F.greatest(F.col("lo") - center, center - F.col("hi"), F.lit(0.0))
    near = regions.join(extent, ["doc_id", "page"]).groupBy("doc_id", "page", "fig_ix").agg(F.min_by("column", F.struct(away.alias("d"), "column")).alias("column"))
    return regions.join(near, ["doc_id", "page", "fig_ix"], "left").withColumn("column", F.coalesce("column", F.lit(0)))


LATTICE = "doc_id {id}, block_ix int, col_x array<double>, row_y array<double>"


def lattices(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, block_ix, col_x, row_y) of each block that closed rules lie over: an interval join by page, then a group for each block."""
    boxes = blocks.where("bbox is not null").select("doc_id", "page", "block_ix", "bbox")
    pairs = boxes.join(rules.select("doc_id", "page", "line_ix", "vertical", "pos", "lo", "hi"), ["doc_id", "page"])

    def of(key: tuple, cols: list[list]):
        found = core.find_lattice(list(zip(*cols[1:], strict=True)), cols[0][0])
        return [(*key, found.xs, found.ys)] if found else []

    return of_groups(pairs, ["doc_id", "block_ix"], ["line_ix"], ["bbox", "vertical", "pos", "lo", "hi"], of, schema.of(LATTICE, id_type(blocks)))


def rule_boundaries(rules: DataFrame) -> DataFrame:
    """(doc_id, page, vertical, boundaries): positions merged within three points. Native: a fold over sorted hundredths."""
    at = F.array_sort(F.collect_list((F.round(F.col("pos") * 100)).cast("bigint")))
    step = lambda acc, v: F.when((F.size(acc) == 0) | (v - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) > int(core.GRID_TOL * 100)), F.concat(acc, F.array(v))).otherwise(acc)
    folded = F.aggregate(at, F.array().cast("array<bigint>"), step)
    good = rules.where((F.abs("pos") < 100_000) & ~F.isnan("pos"))
    return good.groupBy("doc_id", "page", "vertical").agg(F.transform(folded, lambda v: v / 100).alias("boundaries"))


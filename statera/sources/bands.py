"""Rows of print on scanned pages from the ink of each pixel row: bands of ink, runs of bands of even pitch, and the one run that is the
page's table. Ink is a table (doc_id, page, width, y, ink), one row a pixel row, as any image reader counts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The least share of inked pixels in a row of print, the height of such a row in pixels, how far a gap may be from the mean
# pitch of its run, how far heights may spread about their mean, and the rows that make a table.
INK_SHARE = 0.18
LEAST_HEIGHT, MOST_HEIGHT = 3, 40
PITCH_TOLERANCE = 0.08
HEIGHT_SPREAD = 0.25
LEAST_ROWS = 2

_BAND = "struct<top:int,bottom:int>"
_FOLD = f"struct<last:{_BAND},pitch:double,seen:int,run:int,edges:array<struct<run:int,row:int,top:int,bottom:int>>,row:int>"


def print_rows(ink: DataFrame) -> DataFrame:
    """doc_id, page, top, bottom (excluded): pixel rows in a line that carry enough ink, where they are as high as a row of print.

    Pixel rows that follow each other share y minus their rank among the inked ones, so a page is one window and one aggregation, both over
    the same partitioning. A null or missing pixel row carries no ink; a pixel row given twice counts with its larger ink.
    """
    rows = ink.groupBy("doc_id", "page", "y").agg(F.max("ink").alias("ink"), F.max("width").alias("width"))
    enough = rows.filter(F.col("ink") >= F.greatest(F.lit(1), F.floor(F.col("width") * INK_SHARE)))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y"))  # the pixel rows of one page
    bands = enough.withColumn("_at", F.col("y") - rank).groupBy("doc_id", "page", "_at").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"))
    return bands.filter((F.col("bottom") - F.col("top")).between(LEAST_HEIGHT, MOST_HEIGHT)).select("doc_id", "page", F.col("top").cast("int").alias("top"), F.col("bottom").cast("int").alias("bottom"))


def pitch_runs(bands: DataFrame) -> DataFrame:
    """doc_id, page, run (from 0), row (from 0 in its run), top, bottom: the runs of a page's bands whose centres are evenly spaced.

    Gaps between centres are folded from the top of the page with the mean gap of the open run; one further from it than PITCH_TOLERANCE of
    the mean opens the next run, which begins at the lower band of the last gap, so a band that parts two runs is in both. A page of one
    band has no gap and no run. The mean depends on all gaps before, which no window function has; a page's bands are one small array, since
    a page is no higher than its image.
    """
    band = F.struct(F.col("top").cast("int").alias("top"), F.col("bottom").cast("int").alias("bottom"))
    pages = bands.filter("top IS NOT NULL AND bottom IS NOT NULL").groupBy("doc_id", "page").agg(F.sort_array(F.collect_set(band)).alias("b")).filter(F.size("b") >= LEAST_ROWS)
    middle = lambda x: (x["top"] + x["bottom"]) / 2

    def step(state, x):
        gap = middle(x) - middle(state["last"])
        even = F.abs(gap - state["pitch"]) <= PITCH_TOLERANCE * state["pitch"]
        opens = (state["seen"] > 0) & ~even
        seen = F.when(opens, 1).otherwise(state["seen"] + 1)
        pitch = F.when((state["seen"] == 0) | opens, gap).otherwise(state["pitch"] + (gap - state["pitch"]) / seen)
        run = state["run"] + opens.cast("int")
        at = lambda r, i, y: F.struct(r.alias("run"), i.alias("row"), y["top"].alias("top"), y["bottom"].alias("bottom"))
        row = F.when(opens, 1).otherwise(state["row"] + 1)
        more = F.when(opens, F.array(at(run, F.lit(0), state["last"]), at(run, row, x))).otherwise(F.array(at(run, row, x)))
        return F.struct(x.alias("last"), pitch.alias("pitch"), seen.alias("seen"), run.alias("run"), F.concat(state["edges"], more).alias("edges"), row.alias("row")).cast(_FOLD)

    first = F.col("b")[0]
    start = F.struct(
        first.alias("last"), F.lit(0.0).alias("pitch"), F.lit(0).alias("seen"), F.lit(0).alias("run"),
        F.array(F.struct(F.lit(0).alias("run"), F.lit(0).alias("row"), first["top"].alias("top"), first["bottom"].alias("bottom"))).alias("edges"), F.lit(0).alias("row"),
    ).cast(_FOLD)
    runs = pages.select("doc_id", "page", F.explode(F.aggregate(F.expr("slice(b, 2, size(b))"), start, step)["edges"]).alias("e"))
    return runs.select("doc_id", "page", "e.run", "e.row", "e.top", "e.bottom")


def table_rows(bands: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, page, line_no (from 1), top, bottom of the page's table: its longest run, where no other is as long, where it has the rows
    that were promised (expected: doc_id, page, n_rows) and where heights spread by HEIGHT_SPREAD of their mean at most. Any other page gives
    no rows: a run that is not what was read there is not the table."""
    runs = pitch_runs(bands)
    height = F.col("bottom") - F.col("top")
    sizes = runs.groupBy("doc_id", "page", "run").agg(F.count(F.lit(1)).alias("n"), F.avg(height).alias("mean"), F.stddev_pop(height).alias("spread"))
    best = sizes.groupBy("doc_id", "page").agg(F.max_by(F.struct("run", "n", "mean", "spread"), "n").alias("b"), F.max("n").alias("n"))
    ties = sizes.join(best.select("doc_id", "page", "n"), ["doc_id", "page", "n"]).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("ties"))
    one = best.join(ties.filter("ties = 1"), ["doc_id", "page"]).filter((F.col("b.mean") > 0) & (F.col("b.spread") / F.col("b.mean") <= HEIGHT_SPREAD))
    asked = one.join(expected.select("doc_id", "page", "n_rows"), ["doc_id", "page"]).filter(F.col("n") == F.col("n_rows")).select("doc_id", "page", "b.run")
    return runs.join(asked, ["doc_id", "page", "run"]).select("doc_id", "page", (F.col("row") + 1).alias("line_no"), "top", "bottom")

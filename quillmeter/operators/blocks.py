"""Greedy fixed-width billing blocks, without a task that holds them all.

A block opens at the first event past the open block's end, at that event's
local hour cut to the width (``start = ms - within_hour mod min(width, 1 h)``),
and lasts ``width``.  Which event opens the next block depends on the block
before, but only through the block's start, and starts are few: one per cell of
the local hour grid that has events, however many events there are.  So

1. events fold to cells (start, first and last instant): partial aggregates, one
   shuffle; an end inside a cell finds the first instant at or past it there;
2. cells fold to chunks of CHUNK_WIDTHS widths.  A block that is open when a chunk
   begins was opened in the last width before it, so each chunk says, for each of
   those few cells and for none, which block it leaves open: all chunks at once;
3. the chunks' answers are followed in order: a small row per CHUNK_WIDTHS widths
   of time that has events is all that meets in one place;
4. every chunk, told what was open, opens its blocks, and its cells get the block
   that was open and the one opened in them; events join the blocks of their cell.

No window runs over events, no Python runs, and nothing is collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import within_hour

DEFAULT_BLOCK_MS, HOUR_MS = 18_000_000, 3_600_000
#: Widths of time in a chunk
CHUNK_WIDTHS = 16
#: A block as its chunk opens it: where it starts and ends, the cell of its end, the first instant there past it, when it opened
BLOCK = "STRUCT<start: BIGINT, end: BIGINT, end_cell: BIGINT, next_at: BIGINT, opened: BIGINT>"


def cell(ms: Column, tz: str, width: int) -> Column:
    return ms - F.pmod(within_hour(ms, tz), F.lit(min(width, HOUR_MS)))


def _none() -> Column:
    return F.lit(None).cast(BLOCK)


def _opens(block: Column, c: Column) -> Column:
    """The instant at which a cell opens a block while ``block`` is the last one, or null."""
    past = block.isNull() | (c["first"] >= block["end"])
    return F.when(past, c["first"]).when(block["end_cell"] == c["cell"], block["next_at"])


def _block(c: Column, at: Column) -> Column:
    return F.struct(c["cell"].alias("start"), c["end"].alias("end"), c["end_cell"].alias("end_cell"), c["next_at"].alias("next_at"), at.alias("opened")).cast(BLOCK)


def _left_open(cells: Column, block: Column) -> Column:
    """The last block of a chunk that ``block`` enters."""

    def step(last: Column, c: Column) -> Column:
        at = _opens(last, c)
        return F.when(at.isNotNull(), _block(c, at)).otherwise(last)

    return F.aggregate(cells, block.cast(BLOCK), step)


def _all_opened(cells: Column, block: Column) -> Column:
    """The blocks of a chunk in order, after the one that enters it, if any."""

    def step(done: Column, c: Column) -> Column:
        at = _opens(F.get(done, F.size(done) - 1), c)
        return F.when(at.isNotNull(), F.concat(done, F.array(_block(c, at)))).otherwise(done)

    start = F.when(block.isNotNull(), F.array(block)).otherwise(F.array().cast(f"ARRAY<{BLOCK}>"))
    return F.aggregate(cells, start, step)


def chunked(instants: DataFrame, tz: str, width: int) -> DataFrame:
    """(chunk, cells, tail): the cells that have instants, in order, and those of the chunk before whose blocks end in this one."""
    span = CHUNK_WIDTHS * width
    by_cell = instants.groupBy(cell(F.col("ts_ms"), tz, width).alias("cell")).agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    by_cell = by_cell.withColumn("end", F.col("cell") + width)
    by_cell = by_cell.withColumn("end_cell", cell(F.col("end"), tz, width))
    # only an end inside a cell has to look for an instant past it; cells are bounded by the time covered
    # (the second condition always holds: it keeps both uses of the cells one plan, which then runs once)
    inner = by_cell.where("end_cell <> end and first <= last").select(F.col("cell").alias("of"), F.col("end").alias("of_end"), "end_cell")
    hit = instants.select("ts_ms", cell(F.col("ts_ms"), tz, width).alias("end_cell")).join(F.broadcast(inner), "end_cell").where("ts_ms >= of_end")
    after = hit.groupBy("of").agg(F.min("ts_ms").alias("next_at"))
    table = by_cell.join(F.broadcast(after), F.col("cell") == F.col("of"), "left")
    chunk = F.floor(F.col("cell") / span).cast("bigint")
    own, later = F.struct(chunk.alias("chunk"), F.lit(False).alias("tail")), F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("tail"))
    placed = table.select(F.struct("cell", "first", "last", "end", "end_cell", "next_at").alias("c"), F.explode(F.when(F.col("end") > (chunk + 1) * span, F.array(own, later)).otherwise(F.array(own))).alias("at"))
    held = placed.groupBy(F.col("at.chunk").alias("chunk")).agg(*[F.array_sort(F.collect_list(F.when(F.col("at.tail") == t, F.col("c")))).alias(n) for n, t in (("cells", False), ("tail", True))])
    return held.where(F.size("cells") > 0)


def openings(instants: DataFrame, tz: str, width: int) -> DataFrame:
    """(cell, blocks): for each cell that has instants, the block open when it begins and the one opened in it."""
    span = CHUNK_WIDTHS * width
    entered = chunked(instants, tz, width)
    entries = F.concat(F.array(_none()), F.transform("tail", lambda c: _block(c, c["first"])))
    answers = F.transform(entries, lambda b: F.struct(b["start"].alias("entry"), _left_open(F.col("cells"), b).alias("left")))
    summary = entered.select(F.struct("chunk", answers.alias("answers")).alias("s")).groupBy(F.lit(0).alias("_")).agg(F.array_sort(F.collect_list("s")).alias("all"))
    told = f"STRUCT<chunk: BIGINT, block: {BLOCK}>"

    def follow(state: Column, s: Column) -> Column:
        block = F.when(state["chunk"] + 1 == s["chunk"], state["block"])
        # a block that ends before the chunk begins enters it no more
        enters = F.when(block["end"] > s["chunk"] * span, block)
        left = F.get(F.filter(s["answers"], lambda a: a["entry"].eqNullSafe(enters["start"])), 0)["left"]
        return F.struct(s["chunk"].alias("chunk"), left.alias("block"), F.concat(state["told"], F.array(F.struct(s["chunk"].alias("chunk"), enters.alias("block")).cast(told))).alias("told"))

    nothing = F.struct(F.lit(None).cast("bigint").alias("chunk"), _none().alias("block"), F.array().cast(f"ARRAY<{told}>").alias("told"))
    chain = summary.select(F.explode(F.aggregate("all", nothing, follow, lambda state: state["told"])).alias("t")).select(F.col("t.chunk").alias("of"), F.col("t.block").alias("enters"))
    again = entered.where(F.size("tail") >= 0)  # always; keeps both uses of the chunks one plan
    opened = again.join(chain, F.col("chunk") == F.col("of")).select("cells", _all_opened(F.col("cells"), F.col("enters")).alias("blocks"))
    each = opened.select(F.explode("cells").alias("c"), "blocks")
    # a cell opens one block at most, as a block lasts as long as its cell or longer
    known = F.filter("blocks", lambda b: b["opened"] <= F.col("c.last"))
    last = F.slice(known, F.greatest(F.size(known) - 1, F.lit(1)), F.lit(2))
    return each.select(F.col("c.cell").alias("cell"), F.transform(last, lambda b: F.struct(b["opened"].alias("opened"), b["start"].alias("start"))).alias("blocks"))


def with_block(events: DataFrame, tz: str, block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """``events`` (with ts_ms) and block_start; null where there is no instant."""
    width = block_ms if block_ms > 0 else DEFAULT_BLOCK_MS
    opened = openings(events.where("ts_ms is not null").select("ts_ms"), tz, width)
    # the row is held as one struct, so that no column of it can clash with a key's name
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns if c != "block_start"]).alias("row")
    keyed = events.select(row, cell(F.col("ts_ms"), tz, width).alias("of"))
    own = F.element_at(F.filter("blocks", lambda b: b["opened"] <= F.col("row.ts_ms")), -1)["start"]
    joined = keyed.join(opened, F.col("of") == F.col("cell"), "left")
    return joined.select(F.col("row").withField("block_start", own).alias("row")).select("row.*")

"""Mixing sources to target weights by Pfair scheduling (DataFrame and SQL functions only).

A source's rows, in a reproducible order, form blocks of ``block_rows``. With target weight w = s/D
(integer shares s of a period D), block j = 0, 1, ... of a source is released at slot floor(j/w) and
due by slot ceil((j+1)/w); each slot takes, among the released blocks, the one with the earliest
deadline (ties: the first source by name). As the weights add up to one this meets every deadline, so
after any number of slots each source is less than one block away from its target. The schedule
repeats after D slots, so one period is worked out and every row finds its slot by arithmetic and a join.

The schedule of a period is folded over its slots, in one row, whatever the number of sources: a block
is a number (deadline, then source), those that wait are an array, and a slot takes the least. CHUNK
slots take no more than the CHUNK least of the blocks that wait, so the others are set aside and only
looked at again for the next CHUNK slots. A slot costs some 40 bytes; a period has eight slots a source or more.

The mix ends with the row at which every row has been placed once. Sources that are short of their
weight start over (epoch 1, 2, ...), so no row is dropped. With the default target a source gets nine
tenths of its size or more, so the mix is 10/9 of the table at most, but for the rounding of shares
and blocks: blocks are small enough that the wait for a block adds one part in a hundred, as a rule.

Cases: rows without a source form one source with those whose source is empty; equal rows are placed
once for each copy, and are interchangeable; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, text_or_empty
from .numbering import number_rows, unfold

PERIOD = 1000
#: Given shares may add up to this, as the schedule of one period is one row of work.
MOST_PERIOD = 2_000_000
#: Slots for which blocks are looked out of all that wait.
CHUNK = 512
#: A number above all places of sources.
SOURCES = 2**31
#: Schedules of at most this many slots, some 5 MB, are broadcast; longer ones are joined by shuffling.
BROADCAST_PERIOD = 100_000
BLOCK_ROWS = 16
#: Of the default target, this many tenths follow the sources' sizes; the rest is the same for each source.
SIZE_TENTHS = 9


def default_shares(counts: DataFrame, period: int = PERIOD, size_tenths: int = SIZE_TENTHS) -> DataFrame:
    """source, n -> share and d: integers of at least one that add up to d (largest remainders).

    d is the period, or eight times the number of sources if that is more.
    """
    every = Window.partitionBy()
    sized = counts.withColumns({"k": F.count("*").over(every), "total": F.sum("n").over(every)}).where("total > 0")
    sized = sized.withColumn("d", F.greatest(F.lit(period), F.expr("8 * k")).cast("long"))
    wanted = f"CAST(d - k AS DECIMAL(12, 0)) * CAST({size_tenths} * n * k + {10 - size_tenths} * total AS DECIMAL(20, 0))"
    exact = sized.withColumn("num", F.expr(wanted)).withColumn("den", F.expr("10 * k * total"))
    base = exact.withColumn("base", F.expr("1 + num div den")).withColumn("left", F.expr("num % den"))
    spare, rank = F.col("d") - F.sum("base").over(every), F.row_number().over(every.orderBy(F.desc("left"), "source"))
    share = (F.col("base") + F.when(F.col("rank") <= F.col("spare"), 1).otherwise(0)).cast("long")
    return base.withColumns({"spare": spare, "rank": rank}).select("source", "n", share.alias("share"), "d")


def _releases(numbered: DataFrame) -> DataFrame:
    """One row: chunks, an array of slots (the numbers released in each, CHUNK at most) and late (the rest) in order of time.

    Of blocks released in one slot only the CHUNK least can be taken in the chunk.
    """
    blocks = numbered.withColumn("nth", F.explode(F.expr("sequence(0L, share - 1)")))
    coded = blocks.select(F.expr("nth * d div share").alias("slot"), F.expr(f"(((nth + 1) * d + share - 1) div share) * {SOURCES} + i").alias("code"))
    slots = numbered.where("i = 0").select(F.explode(F.expr("sequence(0L, d - 1)")).alias("slot"), F.lit(None).cast("long").alias("code"))
    by_slot = coded.union(slots).groupBy("slot").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    cut = by_slot.select(F.expr(f"slot div {CHUNK}").alias("chunk"), "slot", F.expr(f"slice(codes, 1, {CHUNK})").alias("near"), F.expr(f"slice(codes, {CHUNK} + 1, size(codes))").alias("late"))
    in_order = F.sort_array(F.collect_list(F.struct("slot", "near")))
    chunks = cut.groupBy("chunk").agg(F.transform(in_order, lambda x: x["near"]).alias("slots"), F.flatten(F.collect_list("late")).alias("late"))
    return chunks.agg(F.sort_array(F.collect_list(F.struct("chunk", "slots", "late"))).alias("chunks"))


def period_schedule(shares: DataFrame) -> DataFrame:
    """source, share -> source, nth, slot_in_period: which slot the source's nth block of a period takes."""
    every = Window.partitionBy()
    numbered = shares.select("source", F.col("share").cast("long").alias("share")).where("share > 0")
    numbered = numbered.withColumns({"d": F.sum("share").over(every), "i": F.row_number().over(every.orderBy("source")).cast("long") - 1})
    none = "CAST(array() AS ARRAY<BIGINT>)"
    least = "named_struct('waiting', array_remove(w, x), 'taken', concat(st.taken, array(x)))"
    slot = f"transform(array(concat(st.waiting, released)), w -> transform(array(array_min(w)), x -> {least})[0])[0]"
    chunk = f"aggregate(c.slots, named_struct('waiting', slice(a, 1, {CHUNK}), 'taken', {none}), (st, released) -> {slot})"
    after = f"named_struct('aside', concat(slice(a, {CHUNK} + 1, size(a)), r.waiting, c.late), 'out', concat(so.out, array(r.taken)))"
    step = f"transform(array(sort_array(so.aside)), a -> transform(array({chunk}), r -> {after})[0])[0]"
    start = f"named_struct('aside', {none}, 'out', CAST(array() AS ARRAY<ARRAY<BIGINT>>))"
    run = F.expr(f"aggregate(chunks, {start}, (so, c) -> {step}, so -> so.out)")
    chunks = _releases(numbered).select(F.posexplode(run).alias("chunk", "taken"))
    taken = chunks.select("chunk", F.posexplode("taken").alias("place", "code"))
    taken = taken.select(F.expr(f"CAST(chunk AS BIGINT) * {CHUNK} + place").alias("slot_in_period"), F.expr(f"code div {SOURCES}").alias("due"), F.expr(f"code % {SOURCES}").alias("i"))
    # a source's deadlines are all different, so one tells the block
    return taken.join(numbered, "i").select("source", F.expr("due * share div d - 1").alias("nth"), "slot_in_period")


def _plan(counts: DataFrame, shares: DataFrame | None, period: int) -> DataFrame:
    """source, n, share, d: written, as several steps read it."""
    if shares is None:
        return stored(default_shares(counts, period), "mix-plan")
    wanted = shares.select("source", F.col("share").cast("long").alias("share"))
    plan = stored(counts.join(wanted, "source", "left").withColumn("d", F.sum("share").over(Window.partitionBy())), "mix-plan")
    if plan.where("share IS NULL OR share < 1").count():
        raise ValueError("a source has no share of at least 1")
    if (plan.agg(F.max("d")).first()[0] or 0) > MOST_PERIOD:
        raise ValueError(f"the shares add up to more than {MOST_PERIOD}")
    return plan


def _slotted(blocks: DataFrame, schedule: DataFrame) -> DataFrame:
    """Adds the slot of each block (columns source, share, d, block)."""
    joined = blocks.withColumn("nth", F.expr("block % share")).join(schedule, ["source", "nth"])
    return joined.withColumn("slot", F.expr("(block div share) * d + slot_in_period")).drop("nth", "slot_in_period")


def mix(docs: DataFrame, shares: DataFrame | None = None, key: str = "doc_id", source: str = "source", rest: list[str] | None = None, block_rows: int | None = None, period: int = PERIOD) -> DataFrame:
    """key, source, rest and epoch, block, slot, position: every placement of every row.

    ``shares`` (source, share) are the targets, integers that add up to MOST_PERIOD at most; without it
    :func:`default_shares` are used. ``block_rows`` is BLOCK_ROWS or, if that is less, a hundredth of
    what the least source gets. Ordered by ``position`` (0, 1, 2, ...) the rows are the mixed stream.
    """
    rest = rest or []
    rows = docs.select(F.col(key).alias("key"), text_or_empty(source).alias("source"), *[F.col(c).alias(f"rest_{i}") for i, c in enumerate(rest)])
    plan = _plan(rows.groupBy("source").agg(F.count("*").alias("n")), shares, period)
    schedule = stored(period_schedule(plan), "mix-schedule")
    total, d = plan.agg(F.sum("n"), F.max("d")).first()
    if block_rows is None:
        rows_of_least = plan.agg(F.min(F.expr(f"CAST({total or 0} * share AS DECIMAL(20, 0)) div d"))).first()[0]
        block_rows = min(BLOCK_ROWS, 1 + (rows_of_least or 0) // 100)
    # the mix ends with the last row that is placed for the first time
    last = _slotted(plan.withColumn("block", F.expr(f"(n - 1) div {block_rows}")), schedule)
    end = last.agg(F.max(F.expr(f"slot * {block_rows} + (n - 1) % {block_rows}"))).first()[0]
    # a block that begins before the end is in slot end div block_rows or earlier, so has at most this number in its source
    most = F.expr(f"ceil(({end or 0} div {block_rows} + 1) * share / d) + 2")
    plan = plan.withColumn("most", most.cast("long"))
    if (d or 0) <= BROADCAST_PERIOD:  # as every source has a slot, this bounds both tables
        plan, schedule = F.broadcast(plan), F.broadcast(schedule)
    numbered = number_rows(rows, "key", ["source"], [f"rest_{i}" for i in range(len(rest))], "row_no")
    sized = numbered.join(plan, "source").withColumn("epochs", F.expr(f"(most * {block_rows} - row_no + n - 1) div n"))
    copies = unfold(sized, F.col("epochs"), "epoch").withColumn("q", F.expr("epoch * n + row_no")).withColumn("block", F.expr(f"q div {block_rows}"))
    placed = _slotted(copies, schedule).withColumn("position", F.expr(f"slot * {block_rows} + q % {block_rows}"))
    names = [F.col(f"rest_{i}").alias(c) for i, c in enumerate(rest)]
    placed = placed.where(F.col("position") <= (-1 if end is None else end))
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), *names, F.col("epoch").cast("int").alias("epoch"), "block", "slot", "position")


def mixed_documents(docs: DataFrame, shares: DataFrame | None = None, key: str = "doc_id", source: str = "source", block_rows: int | None = None, period: int = PERIOD) -> DataFrame:
    """The documents, all columns as they are, each as many times as :func:`mix` places it."""
    row, times, own_key, own_row = (free_name(docs, c) for c in ("row_hash", "placements", "placed_key", "placed_row"))
    # maps have no hash of their own
    told = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    hashed = docs.withColumn(row, F.xxhash64(*[told(f) for f in docs.schema.fields]))
    placed = mix(hashed, shares, key, source, [row], block_rows, period).groupBy(F.col(key).alias(own_key), F.col(row).alias(own_row)).agg(F.count("*").alias(times))
    joined = hashed.dropDuplicates([key, row]).join(placed, F.col(key).eqNullSafe(F.col(own_key)) & (F.col(row) == F.col(own_row)))
    return unfold(joined, F.col(times), free_name(joined, "copy")).select(*[F.col(f"`{c}`") for c in docs.columns])

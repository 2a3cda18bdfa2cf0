"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

Each source's documents are put in a hashed order (of id, source and text, where there is one) and cut into blocks. Block k of a source of weight w is released at slot
floor(k / w) and due at slot ceil((k + 1) / w); every slot takes, of the released blocks, the one due first (ties: the
source named first). While no source has run out, each is less than one block away from its target at every slot.

Weights are whole shares of their sum Q, so the schedule repeats after Q slots: it is worked out once for Q slots, in one
expression, and the slot of any block is arithmetic. So is its position: the rows of every source that the schedule has
placed before it, each source counted up to its end. Nothing is sorted globally, no source is gathered in one task (ranks
are taken within hashed parts of a source), and what is broadcast has at most ``PARTS`` rows for each named source.

Every row keeps its place: a source that runs out leaves its slots to the others, which go on in proportion; nothing is
dropped or repeated. Sources without a weight of their own, null among them, share one.

Defined cases: a null id, source or text is ordered as if it were empty text; rows that share an id stand where their texts' hashes
put them, so the order is the same under any partitioning, and many rows of one id are spread; rows that share id, source and
text follow each other; an empty table gives an empty result; other columns are kept by ``mixed``, also such as are named like
its working columns, and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import fresh, quoted

PARTS = 4096
BLOCK = 16

#: Target weights of the production query: shares of 100; "" stands for all other sources together.
TARGETS = {"src0": 24, "src1": 8, "src2": 8, "src3": 8, "src4": 8, "": 44}


def schedule_expression(shares: list[int]) -> str:
    """SQL for the array of sources (by place in ``shares``) in the Q slots of one period."""
    q, p = sum(shares), f"array({', '.join(map(str, shares))})"
    due = f"struct(((s.next[i] + 1) * {q} + {p}[i] - 1) div {p}[i] AS due, i AS i)"
    pick = f"array_min(transform(sequence(0, {len(shares) - 1}), i -> if((s.next[i] * {q}) div {p}[i] <= t, {due}, null))).i"
    # one-element arrays bind the pick to a name
    step = f"transform(array({pick}), c -> named_struct('next', transform(s.next, (n, i) -> if(i = c, n + 1, n)), 'slots', concat(s.slots, array(c))))[0]"
    return f"aggregate(sequence(0, {q - 1}), named_struct('next', array_repeat(0, {len(shares)}), 'slots', cast(array() AS array<int>)), (s, t) -> {step}, s -> s.slots)"


def schedule(spark: SparkSession, shares: list[int]) -> DataFrame:
    """own (source), turn (its block within the period), slot, before (blocks of each source in earlier slots)."""
    one = spark.range(1).select(F.expr(schedule_expression(shares)).alias("slots"))
    slots = one.select("slots", F.posexplode("slots").alias("slot", "own"))
    before = f"transform(sequence(0, {len(shares) - 1}), i -> size(filter(slice(slots, 1, slot), x -> x = i)))"
    return slots.select("own", "slot", F.expr(before).alias("before")).withColumn("turn", F.expr("before[own]"))


def mixed(
    docs: DataFrame, targets: dict[str, int] = TARGETS, block: int = BLOCK, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", column: str = "__mix",
) -> DataFrame:
    """``docs`` with one more column ``column``: struct of block, slot and position. ``text_col`` only breaks ties of ids."""
    spark, names = docs.sparkSession, [n for n in targets if n != ""] + [""]
    if any(targets.get(n, 1) < 1 for n in names):
        raise ValueError("target weights are positive whole numbers")
    shares = [targets.get(n, 1) for n in names]
    q = sum(shares)

    def lookup(values: list, of: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), of + 1)

    own = F.lit(len(names) - 1)
    for i, name in enumerate(names[:-1]):
        own = F.when(F.col(source_col) == name, i).otherwise(own)
    parts = [id_col, source_col] + [text_col] * (text_col in docs.columns)
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]
    order = F.md5(F.concat_ws(":", F.lit(seed), *plain[:2], *(F.md5(t) for t in plain[2:])))
    row = docs.select(F.struct(*quoted(docs.columns)).alias("row"), own.alias("own"), order.alias("order"))
    row = row.withColumn("part", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))

    # rows of a source in earlier parts: at most PARTS rows for each named source
    counts = docs.select(own.alias("own"), F.conv(F.substring(order, 1, 3), 16, 10).cast("int").alias("part")).groupBy("own", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("own").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("own", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    totals = {r["own"]: r["n"] for r in counts.groupBy("own").agg(F.sum("n").alias("n")).collect()}
    total = [totals.get(i, 0) for i in range(len(names))]

    ranked = row.withColumn("rank", F.row_number().over(Window.partitionBy("own", "part").orderBy("order")) - 1)
    ranked = ranked.join(F.broadcast(offsets), ["own", "part"]).withColumn("rank", F.col("offset") + F.col("rank"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block)).withColumn("cycle", F.floor(F.col("block") / lookup(shares, F.col("own"))))
    ranked = ranked.withColumn("turn", (F.col("block") - F.col("cycle") * lookup(shares, F.col("own"))).cast("int"))
    placed = ranked.join(F.broadcast(schedule(spark, shares)), ["own", "turn"])
    position = F.col("rank") % block
    for i, (n, share) in enumerate(zip(total, shares, strict=True)):
        position = position + F.least(F.lit(n), block * (F.col("cycle") * share + F.col("before")[i]))
    mix = F.struct(F.col("block").cast("long").alias("block"), (F.col("cycle") * q + F.col("slot")).cast("long").alias("slot"), position.cast("long").alias("position"))
    return placed.select("row.*", mix.alias(column))


def in_order(docs: DataFrame, targets: dict[str, int] = TARGETS, block: int = BLOCK) -> DataFrame:
    """The documents with their columns only, dealt and sorted by position: files and rows follow the schedule."""
    name = fresh(docs, "__mix")
    place = F.col(f"{name}.position")
    return mixed(docs, targets, block, column=name).repartitionByRange(place).sortWithinPartitions(place).drop(name)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", F.col("__mix.block"), F.col("__mix.slot"), F.col("__mix.position"))


def sql(targets: dict[str, int] = TARGETS, block: int = BLOCK, seed: str = "mix", table: str = "documents") -> str:
    """The same by a plain ranking and a slot-by-slot simulation, in DuckDB's SQL."""
    names = [n for n in targets if n != ""] + [""]
    shares = [targets.get(n, 1) for n in names]
    q, size, p = sum(shares), len(names), "[" + ", ".join(map(str, shares)) + "]"
    cases = " ".join(f"WHEN source = '{n}' THEN {i}" for i, n in enumerate(names[:-1]))
    due = f"(((next[i + 1] + 1) * {q} + {p}[i + 1] - 1) // {p}[i + 1]) * 1000 + i"
    released = f"[CASE WHEN (next[i + 1] * {q}) // {p}[i + 1] <= t THEN {due} END for i in range({size})]"
    pick = f"list_min(list_filter({released}, lambda x: x IS NOT NULL)) % 1000"
    sums = " + ".join(f"least(n[{i + 1}], {block} * ((block // share) * {s} + next[{i + 1}]))" for i, s in enumerate(shares))
    return f"""
WITH RECURSIVE sim AS (
  SELECT 0 AS t, list_transform(range({size}), lambda x: 0) AS next
  UNION ALL
  SELECT t + 1, [next[i + 1] + CASE WHEN i = {pick} THEN 1 ELSE 0 END for i in range({size})] FROM sim WHERE t < {q}),
turns AS (SELECT t AS slot, next, {pick} AS own FROM sim WHERE t < {q}),
ranked AS (
  SELECT doc_id, source, own, row_number() OVER (PARTITION BY own ORDER BY md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, ''))) - 1 AS rank
  FROM (SELECT doc_id, source, CASE {cases} ELSE {size - 1} END AS own FROM {table})),
totals AS (
  SELECT list_transform(range({size}), lambda i: coalesce(m[i::INTEGER], 0)) AS n
  FROM (SELECT map_from_entries(list((own, c))) AS m FROM (SELECT own::INTEGER AS own, count(*) AS c FROM ranked GROUP BY own))),
blocks AS (SELECT *, rank // {block} AS block, {p}[own + 1] AS share FROM ranked)
SELECT doc_id, source, block::BIGINT AS block, ((block // share) * {q} + slot)::BIGINT AS slot, (rank % {block} + {sums})::BIGINT AS position
FROM blocks JOIN turns ON turns.own = blocks.own AND turns.next[blocks.own + 1] = block % share, totals
"""

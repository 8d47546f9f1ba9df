"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows, in a seeded random order, are cut into blocks. With weight w the i-th
block of a source may start at floor((i - 1)/w) and is due at ceil(i/w); running the
eligible block with the earliest deadline in every slot meets all deadlines, so at any
time each source is less than one block away from its share. Weights are whole parts of a
period, after which the schedule repeats: one period a phase is planned on the driver, from
the weights alone, and goes to Spark as the order of its sources, four bytes or so a slot;
a phase ends where a source runs out. Every row finds its slot by a join with that table.

No row is dropped or repeated. Where a source runs out, the others go on in the next
phase with their weights relative to each other.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4  # few, so that small tables are mixed as well; the plan does not depend on it
SMALL_PLAN = 1 << 20  # slots of all periods, and phases of all sources, that are broadcast; more are joined
CELL_ROWS = 8192
ADDED = ["phase", "block", "block_row", "slot", "release", "deadline"]


def pfair_period(parts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(source, i, slot, release, deadline) of one period, i and slot from 0; parts are positive."""
    period = sum(parts.values())
    window = lambda s, i: (i * period // parts[s], -(-(i + 1) * period // parts[s]))
    waiting = [(*window(s, 0), s, 0) for s in parts]
    heapq.heapify(waiting)
    eligible: list[tuple[int, int, int, int]] = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            release, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(eligible, (deadline, s, i, release))
        deadline, s, i, release = heapq.heappop(eligible)
        out.append((s, i, t, release, deadline))
        if i + 1 < parts[s]:
            heapq.heappush(waiting, (*window(s, i + 1), s, i + 1))
    return out


def smoothed_parts(counts: dict, power: float = 0.5, period: int = 1000) -> dict:
    """Parts of a period in proportion to a power of the counts; at least one each."""
    weight = {s: n ** power for s, n in counts.items()}
    total = sum(weight.values())
    return {s: max(1, round(period * w / total)) for s, w in weight.items()}


def schedule(blocks: list[int], parts: list[int]) -> tuple[list[dict], list[dict]]:
    """Phases of each source, and the order of the sources in one period of each phase, for source numbers 0, 1, ..."""
    left, first = list(blocks), [0] * len(blocks)
    sources = [{"sid": s, "firsts": [], "starts": [], "periods": []} for s in range(len(blocks))]
    slots, phase, start = [], 0, 0
    while any(left):
        active = {s: parts[s] for s, n in enumerate(left) if n}
        period, rounds = sum(active.values()), min(-(-left[s] // a) for s, a in active.items())
        slots.append({"phase": phase, "period": period, "order": ",".join(str(slot[0]) for slot in pfair_period(active))})
        for s, a in active.items():
            for key, value in (("firsts", first[s]), ("starts", start), ("periods", period)):
                sources[s][key].append(value)
            sources[s]["phase0"] = sources[s].get("phase0", phase)
            done = min(left[s], rounds * a)
            left[s], first[s] = left[s] - done, first[s] + done
        phase, start = phase + 1, start + rounds * period
    return sources, slots


def mix_sources(docs: DataFrame, parts: dict | None = None, source: str = "source", key: str = "doc_id",
                block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """docs with phase, block, block_row, slot, release and deadline; sort by slot, block_row to read the mixture.

    ``parts`` gives each source its whole share of the period; a source it lacks gets one
    part, one that docs lack is ignored. Without it shares follow the square root of the
    row counts. ``block`` is the number of a row's block within its source, ``slot`` its
    time, release and deadline the times between which it must run. Slots of a source's
    last, missing blocks stay empty. A null source is a source of its own; rows are ordered by
    a hash of all their columns, so null and equal keys are spread, and only rows that are equal
    throughout stand together. An empty table gives no rows. Existing columns with the new
    names are replaced. Sources may be of any number; the plan has the sum of their parts
    as slots for each phase, at most one phase a source.
    """
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    counts = {r[0]: r[1] for r in docs.groupBy(source).count().collect()}  # a row a source
    names = sorted(counts, key=lambda s: (s is not None, s))
    share = parts if parts is not None else smoothed_parts(counts)
    share = [share.get(s, 1) for s in names]
    if min(share, default=1) < 1:
        raise ValueError("parts must be positive")
    plan, slots = schedule([-(-counts[s] // block_rows) for s in names], share)
    for row, s, a in zip(plan, names, share):
        bits = max(0, math.ceil(math.log2(counts[s] / CELL_ROWS)))
        row |= {"source": s, "parts": a, "bits": bits}

    def table(rows, schema):
        literal = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
        return spark.range(1).select(F.inline(literal))

    kind = docs.schema[source].dataType.simpleString()
    sources = table(plan, f"source: {kind}, sid: int, parts: int, bits: int, phase0: int, firsts: array<bigint>, "
                          "starts: array<bigint>, periods: array<bigint>")
    sources = sources.select(*[F.col(c).alias(f"__{c}") for c in sources.columns])
    # Its i-th slot in the order is a source's i-th block; release and deadline follow from i.
    pattern = table(slots, "phase: int, period: int, order: string").select(
        "phase", "period", F.posexplode(F.split("order", ",")).alias("__at", "__sid"))
    number = F.row_number().over(Window.partitionBy("phase", "__sid").orderBy("__at")) - 1
    owner = sources.select("__sid", F.col("__parts").alias("__share"))
    pattern = pattern.withColumns({"__sid": F.col("__sid").cast("int"), "__i": number}).join(owner, "__sid").select(
        "__sid", "phase", "__i", "__at", F.expr("__i * period div __share").alias("__opens"),
        F.expr("((__i + 1) * period + __share - 1) div __share").alias("__due"))
    small = sum(r["period"] for r in slots) + sum(len(r["firsts"]) for r in plan) <= SMALL_PLAN
    bounded = F.broadcast if small else lambda t: t

    hashed = docs.join(bounded(sources), F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    hashed = hashed.withColumn("__order", F.xxhash64(F.lit(seed), *plain))
    cell = F.when(F.col("__bits") > 0, F.expr("shiftrightunsigned(__order, 64 - __bits)")).otherwise(F.lit(0).cast("long"))
    hashed = hashed.withColumn("__cell", cell)
    sizes = hashed.groupBy("__sid", "__cell").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__sid").orderBy("__cell")) - F.col("__n")
    sizes = sizes.select("__sid", "__cell", before.alias("__before"))
    order = F.expr("shiftrightunsigned(__order, 1)")
    rank = F.row_number().over(Window.partitionBy("__sid", "__cell").orderBy(order, "__order", key))
    ranked = hashed.withColumn("__rank", rank).join(sizes, ["__sid", "__cell"])
    ranked = ranked.withColumn("__place", F.col("__before") + F.col("__rank") - 1)

    block = ranked.withColumns({"block": F.expr(f"__place div {block_rows}"),
                                "block_row": (F.col("__place") % block_rows).cast("int")})
    block = block.withColumn("__at_phase", F.size(F.filter("__firsts", lambda x: x <= F.col("block"))))
    block = block.withColumns({
        "phase": F.col("__phase0") + F.col("__at_phase") - 1,
        "__in": F.col("block") - F.element_at("__firsts", F.col("__at_phase")),
        "__start": F.element_at("__starts", F.col("__at_phase")),
        "__period": F.element_at("__periods", F.col("__at_phase"))})
    block = block.withColumns({"__i": (F.col("__in") % F.col("__parts")).cast("int"),
                               "__begin": F.col("__start") + F.expr("__in div __parts") * F.col("__period")})
    timed = block.join(bounded(pattern), ["__sid", "phase", "__i"])
    return timed.select(*docs.columns, "phase", "block", "block_row", (F.col("__begin") + F.col("__at")).alias("slot"),
                        (F.col("__begin") + F.col("__opens")).alias("release"),
                        (F.col("__begin") + F.col("__due")).alias("deadline"))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, rows over partitions and within them in the order of the mixture."""
    mixed = mix_sources(docs, **options)
    rows = mixed.repartitionByRange("slot", "block_row").sortWithinPartitions("slot", "block_row")
    return rows.select(*[c for c in docs.columns])

"""Filling containers of fixed capacity with items, by bulk-synchronous best fit.

A text larger than a container first gives up full containers, so that only its rest is an item. The items are
taken in bands of falling size, each a sixteenth of the one before, for all capacities at once. A superstep:

1. every container with room for an item of the band offers slots: one of the largest size left in the band for
   each time that fits into its gap, and one of what remains of the gap;
2. items and slots are range-sorted together by falling size, and swept: an item takes its successor, the
   smallest slot that is not smaller and not taken. Items and slots are like brackets, so each range is swept by
   itself with a stack; what a range can't match is an item without a slot (closing) or a slot without an item
   (opening), and the rank in the running depth over the ranges says which of them belong together: a depth holds at
   most one item and one slot of a range, so conflicts are settled in small groups;
3. gaps shrink by what was put into them; where the items left hold more than the gaps that could take
   one, new containers open for the difference, and the step repeats until the band is placed.

Every step is a range sort and joins on item or container. The driver sees a row per capacity, and a row per
capacity and range. A container offers no more slots than twice its share of the items, so slots are at most
twice the items plus the containers. Best fit item by item fills no better on the test tables (see the README).

Defined cases: items of size 0 go into container 0; null sizes count as 0; rows without id are
skipped; equal sizes are ranked by id, so the packing doesn't depend on order; an id
that occurs twice is two items; capacities that are null or below one are no containers; an empty table gives no rows;
containers are numbered from 0 per capacity, split parts have containers of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.runtime import discard, materialize, scratch

#: A band reaches from one size down to this part of it; the last one takes all sizes from LAST_BAND down.
BAND_PART = 16
LAST_BAND = 64

_SWEPT = "kind string, pack_name string, pid int, place bigint, item bigint, doc_id bigint, size bigint, cont bigint"
_COLUMNS = [c.split()[0] for c in _SWEPT.split(", ")]


def band_tops(capacity: int) -> list[int]:
    """Largest size of each band."""
    tops = [capacity]
    while tops[-1] > LAST_BAND:
        tops.append(tops[-1] // BAND_PART)
    return tops


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range in order. Kind m is an item in a slot, i an item without (the place-th), s a slot without (place from the bottom).

    Kind d counts for each capacity the items (place) and slots (item) without.
    """
    pid = TaskContext.get().partitionId()
    pack, stack, alone = None, [], 0

    def rest() -> list[tuple]:
        return [("s", pack, pid, k, -1, -1, 0, c) for k, c in enumerate(stack, 1)] + [("d", pack, pid, alone, len(stack), -1, 0, -1)] * (alone + len(stack) > 0)

    for b in batches:
        out = []
        for p, kind, item, doc, size, cont in zip(b["pack_name"], b["kind"], b["item"], b["doc_id"], b["size"], b["cont"]):
            if p != pack:
                out += rest()
                pack, stack, alone = p, [], 0
            if kind == 0:
                stack.append(cont)
            elif stack:
                out.append(("m", p, pid, 0, item, doc, size, stack.pop()))
            else:
                alone += 1
                out.append(("i", p, pid, alone, item, doc, size, -1))
        yield pd.DataFrame(out, columns=_COLUMNS)
    yield pd.DataFrame(rest(), columns=_COLUMNS)


def _small(spark: SparkSession, **columns: list) -> DataFrame:
    """A table of a few driver rows, to be broadcast."""
    return F.broadcast(spark.createDataFrame(pa.table(columns)))


def _depths(swept: DataFrame) -> DataFrame:
    """Per range and capacity the depth of slots before it, and after its items went."""
    depth: dict[str, int] = {}
    out = []
    for r in sorted(swept.where("kind = 'd'").collect(), key=lambda r: r["pid"]):
        d = depth.get(r["pack_name"], 0)
        after = max(0, d - r["place"])
        out.append((r["pack_name"], r["pid"], d, after))
        depth[r["pack_name"]] = after + r["item"]
    name, pid, before, after = zip(*out) if out else ([""], [-1], [0], [0])
    return _small(swept.sparkSession, pack_name=pa.array(name, "string"), pid=pa.array(pid, "int32"), before=pa.array(before, "int64"), after=pa.array(after, "int64"))


def matched(items: DataFrame, slots: DataFrame) -> DataFrame:
    """Each item with the successor of its size among the slots (``cont``, null where there is none).

    ``items`` has pack_name, item, doc_id, size; ``slots`` pack_name, cont, size, gap.
    """
    none = F.lit(-1).cast("bigint")
    both = slots.select("pack_name", F.lit(0).alias("kind"), none.alias("item"), none.alias("doc_id"), "size", "cont", "gap").unionByName(
        items.select("pack_name", F.lit(1).alias("kind"), "item", "doc_id", "size", none.alias("cont"), none.alias("gap"))
    )
    order = [F.col("pack_name"), F.col("size").desc(), F.col("kind"), F.col("gap").desc(), F.col("cont"), F.col("doc_id"), F.col("item")]
    n = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    swept = materialize(both.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_sweep, _SWEPT), "swept")
    # a depth is that of the slot an item takes; below one there is none left
    depth = F.when(F.col("kind") == "i", F.col("before") - F.col("place") + 1).otherwise(F.col("after") + F.col("place"))
    lone = swept.where("kind in ('i', 's')").join(_depths(swept), ["pack_name", "pid"]).withColumn("depth", depth)
    # items without any slot have depths of their own below one, so no group of the window has more than two rows of a range
    w = Window.partitionBy("pack_name", "depth").orderBy("pid", "kind")
    pairs = lone.withColumn("cont", F.when(F.col("depth") > 0, F.lag("cont").over(w))).where("kind = 'i'")
    cols = ["pack_name", "item", "doc_id", "size", "cont"]
    out = swept.where("kind = 'm'").select(*cols).unionByName(pairs.select(*cols))
    out._quern_path = swept._quern_path  # what it is read from, to be discarded with it
    return out


def _new_containers(spark: SparkSession, new: list[tuple[str, int, int, int]]) -> DataFrame:
    """Rows for (pack_name, capacity, first number, count); a range over all of them, so no task makes more than its part."""
    ids, at, name, cap, first = F.col("id"), 0, F.lit(""), F.lit(0), F.lit(0)
    for p, c, f, n in new:
        here = ids >= at
        name, cap, first = F.when(here, p).otherwise(name), F.when(here, c).otherwise(cap), F.when(here, f - at).otherwise(first)
        at += n
    return spark.range(at).select(name.alias("pack_name"), (ids + first).cast("bigint").alias("cont"), cap.cast("bigint").alias("gap"))


def _state(items: DataFrame, containers: DataFrame) -> dict[str, dict]:
    """Per capacity with items left: their number, tokens, largest and smallest size, and number and sum of the gaps that could take one."""
    rows = items.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"), F.max("size").alias("top"), F.min("size").alias("low")).collect()
    state = {r["pack_name"]: r.asDict() | {"n_gaps": 0, "free": 0} for r in rows}
    if state:
        low = reduce(lambda c, r: F.when(F.col("pack_name") == r["pack_name"], r["low"]).otherwise(c), rows, F.lit(None))
        for r in containers.where(F.col("gap") >= low).groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("gap").alias("free")).collect():
            state[r["pack_name"]] |= r.asDict()
    return state


def _slots(containers: DataFrame, state: dict[str, dict]) -> DataFrame:
    s = list(state.values())
    most = [1 + 2 * r["n"] // max(1, r["n_gaps"]) for r in s]
    given = _small(containers.sparkSession, pack_name=pa.array(list(state), "string"), top=pa.array([r["top"] for r in s], "int64"), low=pa.array([r["low"] for r in s], "int64"), most=pa.array(most, "int64"))
    c = containers.join(given, "pack_name").where("gap >= low")
    whole, left = F.least(F.floor(F.col("gap") / F.col("top")), "most").cast("int"), F.col("gap") % F.col("top")
    sizes = F.concat(F.array_repeat("top", whole), F.when(left >= F.col("low"), F.array(left)).otherwise(F.array().cast("array<bigint>")))
    return c.select("pack_name", "cont", F.explode(sizes).alias("size"), "gap")


def placed(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(pack_name, item, size, cont) of all items; ``items`` has pack_name, item, doc_id, size, band, and is stored by band."""
    spark = items.sparkSession
    schema = "pack_name string, item bigint, doc_id bigint, size bigint, cont bigint"
    root, step = scratch(spark, "placed"), 0
    containers = spark.createDataFrame([], "pack_name string, cont bigint, gap bigint")
    opened, stored = dict.fromkeys(capacities, 0), None
    for band in range(max(len(band_tops(c)) for c in capacities.values())):
        left, first = items.where(F.col("band") == band).drop("band"), True
        while state := _state(left, containers):
            new = []
            for p, r in state.items():
                short = r["tokens"] - r["free"]
                if short > 0 and not (first and r["n_gaps"]):
                    n = -(-short // capacities[p])
                    new.append((p, capacities[p], opened[p], n))
                    opened[p] += n
                    r["n_gaps"] += n
            if new:
                containers = containers.unionByName(_new_containers(spark, new))
            here = f"{root}/step={step}"
            fresh = matched(left, _slots(containers, state))
            fresh.write.parquet(here)
            discard(fresh)
            m = spark.read.schema(schema).parquet(here)
            used = m.where("cont is not null").select("pack_name", "cont", (-F.col("size")).alias("gap"))
            before, containers = stored, materialize(containers.unionByName(used).groupBy("pack_name", "cont").agg(F.sum("gap").alias("gap")).where("gap > 0"), "containers")
            if before is not None:
                discard(before)
            stored = containers
            left, step, first = m.where("cont is null").drop("cont"), step + 1, False
    if not step:
        return spark.createDataFrame([], schema).drop("doc_id")
    return spark.read.schema(f"{schema}, step int").parquet(root).where("cont is not null").select("pack_name", "item", "size", "cont")


def _band(size: Column, capacity: Column, bands: int) -> Column:
    """Number of the band of a size; tops as in ``band_tops``."""
    top, tops = capacity, []
    for _ in range(bands - 1):
        tops.append((F.floor(top / BAND_PART), top > LAST_BAND))
        top = tops[-1][0]
    return reduce(lambda a, b: a + b, [F.when(more & (size <= t), 1).otherwise(0) for t, more in tops], F.lit(0))


def pack(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """doc_id, pack_name, piece_no, tokens, container, fill_tokens: a row per part of a text.

    ``sizes`` has doc_id and n_tokens, ``packs`` pack_name and capacity_tokens: a settings table, of which the driver
    holds all rows; of several capacities of a name the largest counts.
    """
    spark = sizes.sparkSession
    caps = {r["pack_name"]: r["c"] for r in packs.where("capacity_tokens > 0 and pack_name is not null").groupBy("pack_name").agg(F.max(F.col("capacity_tokens").cast("bigint")).alias("c")).collect()}
    if not caps:
        return spark.createDataFrame([], "doc_id bigint, pack_name string, piece_no bigint, tokens bigint, container string, fill_tokens bigint")
    options = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity")) for n, c in sorted(caps.items())])
    base = sizes.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n")).withColumn("_m", F.monotonically_increasing_id())
    items = base.withColumn("_o", F.explode(options)).select("doc_id", F.col("_m").alias("item"), "n", "_o.pack_name", "_o.capacity")
    items = items.withColumn("parts", F.floor(F.col("n") / F.col("capacity"))).withColumn("size", F.col("n") - F.col("parts") * F.col("capacity"))
    bands = max(len(band_tops(c)) for c in caps.values())
    items = materialize(items.withColumn("band", F.when(F.col("size") > 0, _band(F.col("size"), F.col("capacity"), bands)).otherwise(-1)), "items", ["band"])
    done = placed(items.where("band >= 0").select("pack_name", "item", "doc_id", "size", "band"), caps)
    fill = done.groupBy("pack_name", "cont").agg(F.sum("size").alias("fill_tokens"))
    rests = done.join(fill, ["pack_name", "cont"]).join(items.where("band >= 0").select("pack_name", "item", "doc_id", "parts"), ["pack_name", "item"])
    out = rests.select("doc_id", "pack_name", F.col("parts").alias("piece_no"), F.col("size").alias("tokens"), F.col("cont").cast("string").alias("container"), "fill_tokens")
    first = fill.where("cont = 0").select("pack_name", "fill_tokens")  # a row per capacity
    nothing = items.where("n = 0").join(F.broadcast(first), "pack_name", "left").select("doc_id", "pack_name", F.col("parts").alias("piece_no"), F.col("size").alias("tokens"), F.lit("0").alias("container"), F.coalesce("fill_tokens", F.lit(0)).alias("fill_tokens"))
    whole = items.where("parts > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    whole = whole.select("doc_id", "pack_name", "piece_no", F.col("capacity").alias("tokens"), F.concat_ws("-", F.lit("whole"), "doc_id", "item", "piece_no").alias("container"), F.col("capacity").alias("fill_tokens"))
    return out.unionByName(nothing).unionByName(whole)


def fills(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per container size: containers, tokens, and the part of the capacity that is used."""
    per = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("tokens"))
    j = per.join(packs.groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens")), "pack_name")
    return j.withColumn("fill", F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")))

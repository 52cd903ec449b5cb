"""Mixing sources to target weights, in DataFrame operations only.

Targets: the sources share a budget (a multiple of all words) by weight; no target exceeds
``most`` times its source, and what that leaves over is shared again by weight among the others.

Drawing: each document has a random place, a hash of its id and text. A source whose target is at least
its size takes every document once and a part of them again; any other takes a part. A part is what lies
before a cut in the order of places: the cut is found by counts over ever finer ranges, so nothing is sorted. The
document at which the words run out is passed over, and the cut is moved on past it for what is still missing, until
that is a few documents' worth. The rest is made up from the documents that follow, each that still fits, and at last
from the one document of the source that comes nearest to what is missing, if it does so more than none.

Dealing: the places of a source fall into blocks, equal ranges of them, and a splitting tree deals the taken
blocks out: at each node, of all block tokens below it half are drawn without replacement for the left child, so
each source's count there is multivariate hypergeometric and the exact quotas of all shards add up to the blocks
taken. Within a source the blocks are permuted and handed to the shards by quota, each once; within a shard the
order is a hash of the document.

Scale: texts are read once for words and places; all that is joined are those and tables of a row per source, per
block or per document that makes up a rest. There are about ``blocks`` blocks in all, at any size of input, and
they are never gone through document by document: decisions are comparisons of places. The documents that may make
up a rest are a range of places that holds some ``NEAR`` of them, however many there are. All randomness is a hash:
reruns and recomputed tasks agree.

Null texts have size 0. A null source is a source of its own, last in order. Null doc_ids and repeated rows are
ordinary rows; rows equal in id and text are decided alike. Sources without words have target 0 and are not
taken. An empty table gives an empty result. Extra columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, free_name, named

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2.0
SHARDS = 16
BLOCKS = 4096
SEED = 20240611
#: Documents, about, among which the last words of a target are looked for.
NEAR = 2048
#: The cut is moved on while more than so many mean documents are missing.
CLOSE = 64
#: Places that are counted one by one once a range holds so few.
FEW = 4096
#: Documents whose choice is added at once, so that long lists are not copied for each.
FILL = 256


def word_count(text: str) -> Column:
    """Words are runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(named([text])[0], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(src, source_size, units, target) from (src, size); src: '' for null, else '=' and the name.

    One row per source. With the sources in order of cap over weight, the share of one unit of
    weight if the first i are at their cap is ``(budget - their caps) / weight of the others``;
    the level is that share at the first source it does not push above its cap.
    """
    per = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    by_name = Window.orderBy(F.col("src") == "", "src")
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    per = per.withColumn("i", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("i"))
    level = F.min_by("level", fits).over(whole)
    per = per.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))))
    return per.select("src", "source_size", "units", "target")


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(src, shard, quota) from (src, quota): exact quotas of block tokens per shard.

    ``shards`` must be a power of two. A node's tokens are as many as the blocks below it.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = quotas.select("src", F.col("quota").cast("long").alias("quota"), F.lit(0).alias("shard"))
    while shards > 1:
        tokens = nodes.where("quota > 0").select("src", "shard", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("token"))
        draw = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.lit(shards), "shard", "src", "token"), "src", "token")
        all_of = F.count("*").over(Window.partitionBy("shard"))
        odd = F.pmod(F.col("shard"), F.lit(2)).cast("long")  # halves of odd nodes round the other way
        left = F.row_number().over(draw) <= F.floor((all_of + 1 - odd) / 2)
        nodes = tokens.select("src", (F.col("shard") * 2 + F.when(left, 0).otherwise(1)).alias("shard")).groupBy("src", "shard").agg(F.count("*").alias("quota"))
        shards //= 2
    return nodes


def _fill(rest: Column, found: Column) -> Column:
    """(rest, places): the places of ``found``, an array of (place, size), each in order if it still fits into what is
    left of ``rest`` words, and what is left at the end."""
    none = F.expr("cast(array() as array<bigint>)")

    def step(s, x):
        fits = x["size"] <= s["rest"]
        return F.struct(F.when(fits, s["rest"] - x["size"]).otherwise(s["rest"]).alias("rest"), F.when(fits, F.concat(s["places"], F.array(x["place"]))).otherwise(s["places"]).alias("places"))

    def part(s, i):
        own = F.aggregate(F.slice(found, i * FILL + 1, F.lit(FILL)), F.struct(s["rest"].alias("rest"), none.alias("places")), step)
        return F.transform(F.array(own), lambda o: F.struct(o["rest"].alias("rest"), F.concat(s["places"], o["places"]).alias("places")))[0]

    parts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(found) - 1, F.lit(0)) / FILL).cast("int"))
    return F.aggregate(parts, F.struct(rest.alias("rest"), none.alias("places")), part)


def _in_ranges(steps: str = "steps") -> Column:
    inside = F.exists(steps, lambda s: (s["lo"].isNull() | (F.col("place") > s["lo"])) & (F.col("place") <= s["hi"]) & (F.col("size") <= s["biggest"]))
    return F.coalesce(inside, F.lit(False))


def move_cuts(units: DataFrame, state: DataFrame) -> DataFrame:
    """(src, upto, taken): for each row of ``state(src, after, room, biggest)`` the last place up to which the documents of
    ``units(src, place, size)`` beyond ``after``, of at most ``biggest`` words, have at most ``room`` words together.

    ``after`` null: from the first place on. ``upto`` is ``after`` if none has room. Ranges of 4096 parts are counted, and the
    one in which the room ends is looked at again, until it holds ``FEW`` documents at most.
    """
    # null size bounds and places before ``after`` fall out here; a row per source is joined
    found = units.where("size > 0").join(state, "src").where((F.col("size") <= F.col("biggest")) & (F.col("after").isNull() | (F.col("place") > F.col("after")))).select("src", "place", "size")
    open_ = state.select("src", F.coalesce("after", F.lit(-(1 << 63))).alias("lo"), F.lit((1 << 63) - 1).alias("hi"), F.col("room").alias("left"), F.lit(0).cast("long").alias("taken"))
    sure = None  # sources whose documents all have room
    by_src = Window.partitionBy("src")
    for shift in (52, 40, 28, 16, 4, 0):
        inside = found.join(open_, "src").where("place between lo and hi")
        parts = inside.groupBy("src", F.shiftright("place", shift).alias("part")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
        parts = parts.join(open_.select("src", "left", "taken"), "src").withColumn("end", F.sum("words").over(by_src.orderBy("part")))
        parts = cut(parts, "mix-ranges")  # 4096 rows a source at most
        edge = parts.where("end > left").groupBy("src").agg(F.min_by(F.struct("first", "last", "n", (F.col("end") - F.col("words")).alias("before"), "left", "taken"), "part").alias("e"))
        edge = cut(edge.select("src", "e.*"), "mix-edges")
        whole = parts.join(edge.select("src"), "src", "left_anti").groupBy("src").agg(F.max("last").alias("upto"), (F.max("taken") + F.sum("words")).alias("taken"))
        sure = whole if sure is None else sure.unionByName(whole)
        open_ = edge.select("src", F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("left") - F.col("before")).alias("left"), (F.col("taken") + F.col("before")).alias("taken"))
        most = edge.agg(F.max("n")).first()[0]
        if most is None or most <= FEW:
            break
    inside = found.join(open_, "src").where("place between lo and hi").groupBy("src", "place").agg(F.sum("size").alias("words"), F.max("lo").alias("lo"), F.max("left").alias("left"), F.max("taken").alias("taken"))
    each = inside.withColumn("end", F.sum("words").over(by_src.orderBy("place")))
    last = each.groupBy("src").agg(F.coalesce(F.max(F.when(F.col("end") <= F.col("left"), F.col("place"))), F.max("lo") - 1).alias("upto"), (F.max("taken") + F.coalesce(F.max(F.when(F.col("end") <= F.col("left"), F.col("end"))), F.lit(0))).alias("taken"))
    moved = sure.unionByName(last)
    return state.join(moved, "src", "left").select("src", F.coalesce("upto", "after").alias("upto"), F.coalesce("taken", F.lit(0)).alias("taken"))


def draw(units: DataFrame, per: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which documents make up the part of each source: (src, lo, hi, biggest), ranges of places in which all documents of at
    most ``biggest`` words are taken, and (src, place), single ones. ``per``: (src, source_size, units, rest)."""
    state = cut(per.where("rest > 0").select("src", F.lit(None).cast("long").alias("after"), F.col("rest").alias("room"), F.col("rest").alias("biggest"), (F.col("source_size") / F.col("units")).alias("mean"), "units"), "mix-state")
    ranges = state.select("src", F.col("after").alias("lo"), F.col("after").alias("hi"), "biggest").where("false")
    while True:
        moved = cut(move_cuts(units, state.select("src", "after", "room", "biggest")), "mix-moved")
        both = state.join(moved, "src")
        ranges = ranges.unionByName(both.where("upto is not null").select("src", F.col("after").alias("lo"), F.col("upto").alias("hi"), "biggest"))
        room = F.col("room") - F.col("taken")
        # nothing was taken: what is missing stays, and only single documents can help
        state = cut(both.select("src", F.col("upto").alias("after"), room.alias("room"), room.alias("biggest"), "mean", "units", (F.col("taken") > 0).alias("going")), "mix-state")
        if not state.where(F.col("going") & (F.col("room") > CLOSE * F.col("mean"))).limit(1).count():
            break
    # places are even over 2^64, so this range holds about NEAR documents; the last one ends where places end
    step = F.least(F.lit(float(1 << 63)), F.lit(float(1 << 63)) / F.col("units") * (2 * NEAR))
    begin = F.coalesce("after", F.lit(-(1 << 63)))
    end = F.least(begin.cast("double") + step, F.lit(float((1 << 63) - 1024))).cast("long")
    near = state.select("src", "after", "room", F.when(F.col("units") <= NEAR, F.lit((1 << 63) - 1)).otherwise(end).alias("end"))
    near = units.where("size > 0").join(near, "src").where("(after is null or place > after) and place <= end")
    near = near.groupBy("src", "place").agg(F.sum("size").alias("size"), F.max("room").alias("room"))
    listed = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("found"), F.max("room").alias("room"))
    filled = cut(state.select("src", "room").join(listed.select("src", _fill(F.col("room"), F.col("found")).alias("f")), "src", "left").select("src", F.coalesce("f.rest", "room").alias("left"), "f.places"), "mix-filled")
    ranges = cut(ranges, "mix-taken")
    single = filled.select("src", F.explode("places").alias("place"))
    # of all that is left out, the one document that comes nearest to what is still missing, if that is nearer than none
    steps = ranges.groupBy("src").agg(F.collect_list(F.struct("lo", "hi", "biggest")).alias("steps"))
    others = units.where("size > 0").join(filled.where("left > 0").select("src", "left").join(steps, "src", "left"), "src").where(~_in_ranges() & (F.abs(F.col("left") - F.col("size")) < F.col("left")))
    others = others.join(single, ["src", "place"], "left_anti").groupBy("src").agg(F.min_by("place", F.struct(F.abs(F.col("left") - F.col("size")), "place")).alias("place"))
    # copies of it come with it
    copies = units.join(cut(others, "mix-nearest"), ["src", "place"]).groupBy("src", "place").agg(F.sum("size").alias("words"))
    nearest = copies.join(filled.select("src", "left"), "src").where(F.abs(F.col("left") - F.col("words")) < F.col("left")).select("src", "place")
    return ranges, cut(single.unionByName(nearest), "mix-single")


def _block(bits: str = "bits") -> Column:
    """The block of a place: its first bits."""
    return F.when(F.col(bits) == 0, F.lit(0)).otherwise(F.expr(f"shiftright(place, 64 - {bits})")).cast("long")


def plan_blocks(units: DataFrame, per: DataFrame, ranges: DataFrame, single: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(src, block, base_shard, extra_shard): where a block goes as a whole, and where what is drawn from it goes."""
    here = units.join(per.where("target > 0").select("src", "bits"), "src").select("src", _block().alias("block")).distinct()
    ends = ranges.select("src", F.col("hi").alias("place")).unionByName(single).groupBy("src").agg(F.max("place").alias("place"))
    ends = ends.join(per.select("src", "bits"), "src").select("src", _block().alias("upto"))
    blocks = cut(here.join(per.select("src", "base"), "src").join(ends, "src", "left").select("src", "block", "base", F.coalesce(F.col("block") <= F.col("upto"), F.lit(False)).alias("extra")), "mix-blocks")
    taken = blocks.select("src", "block", F.explode(F.array_compact(F.array(F.when(F.col("base"), 0), F.when(F.col("extra"), 1)))).alias("epoch"))
    quotas = split_tree(taken.groupBy("src").agg(F.count("*").alias("quota")), shards, seed)
    upto = Window.partitionBy("src").orderBy("shard")
    slots = quotas.withColumn("to", F.sum("quota").over(upto)).select("src", "shard", F.explode(F.sequence(F.col("to") - F.col("quota") + 1, F.col("to"))).alias("slot"))
    permuted = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "src", "epoch", "block"), "epoch", "block")
    dealt = taken.withColumn("slot", F.row_number().over(permuted).cast("long")).join(slots, ["src", "slot"])
    dealt = dealt.groupBy("src", "block").agg(F.max(F.when(F.col("epoch") == 0, F.col("shard"))).alias("base_shard"), F.max(F.when(F.col("epoch") == 1, F.col("shard"))).alias("extra_shard"))
    return cut(dealt, "mix-plan")


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """(row, src, place, size): the whole row in one column, so that its names cannot clash."""
    names = named(docs.columns)
    one = F.struct(*names).alias("row")
    key, words, src = named([doc_id, text, source])
    return docs.select(one, F.when(src.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), src)).alias("src"), F.xxhash64(F.lit(seed), key, words).alias("place"), word_count(text).alias("size"))


def _plan(units: DataFrame, weights, budget, most, shards, blocks, seed) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sources, plan of blocks, ranges, single documents) from a table (src, place, size)."""
    per = targets(units, weights, budget, most)
    whole = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per source
    parts = F.lit(float(blocks)) * F.col("units") / F.greatest(F.sum("units").over(whole), F.lit(1))
    parts = F.greatest(F.lit(1.0), F.least(parts, F.col("units") / 32))  # blocks of a few dozen documents at least
    per = per.withColumns({"bits": F.floor(F.log2(parts)).cast("int"), "base": F.col("target") >= F.col("source_size")})
    per = cut(per.withColumn("rest", F.col("target") - F.when(F.col("base"), F.col("source_size")).otherwise(0)), "mix-sources")
    ranges, single = draw(units, per)
    return per, plan_blocks(units, per, ranges, single, shards, seed), ranges, single


def _decide(rows: DataFrame, per: DataFrame, plan: DataFrame, ranges: DataFrame, single: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and the array ``shards`` of those that each row goes to."""
    steps = ranges.groupBy("src").agg(F.collect_list(F.struct("lo", "hi", "biggest")).alias("steps"))  # halvings of a target at most
    rows = rows.join(per.select("src", "source_size", "target", "bits").join(steps, "src", "left"), "src", "left").withColumn("block", _block())
    rows = rows.join(single.withColumn("single", F.lit(True)), ["src", "place"], "left").join(plan, ["src", "block"], "left")
    extra = _in_ranges() | F.coalesce("single", F.lit(False))
    shards = F.array_compact(F.array("base_shard", F.when(extra, F.col("extra_shard"))))
    return rows.withColumn("shards", F.coalesce(shards, F.expr("cast(array() as array<int>)"))).drop("steps", "single", "base_shard", "extra_shard", "bits", "block")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, budget=BUDGET, most=MOST, shards=SHARDS, blocks=BLOCKS, seed=SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): one row per input row."""
    rows = cut(_keyed(docs.select(*named([doc_id, text, source])), doc_id, text, source, seed).select(F.col(f"row.`{doc_id}`").alias("doc_id"), "src", "place", "size"), "mix-sizes")
    out = _decide(rows, *_plan(rows.select("src", "place", "size"), weights, budget, most, shards, blocks, seed))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, budget=BUDGET, most=MOST, shards=SHARDS, blocks=BLOCKS, seed=SEED) -> DataFrame:
    """The mixed documents: the columns of ``docs``, then ``shard`` and ``shard_order``, a row per copy.

    Sorting the rows of a shard by ``shard_order`` shuffles it. Where ``docs`` has columns of these names, the added
    ones end in underscores.
    """
    rows = _keyed(docs, doc_id, text, source, seed)
    units = cut(rows.select("src", "place", "size"), "mix-sizes")
    out = _decide(rows, *_plan(units, weights, budget, most, shards, blocks, seed)).select("row", "place", F.posexplode("shards").alias("epoch", "to"))
    names = docs.columns
    order = F.xxhash64(F.lit(seed), "to", "epoch", "place")
    return out.select(*(F.col(f"row.`{c.replace('`', '``')}`").alias(c) for c in names), F.col("to").alias(free_name(docs, "shard")), order.alias(free_name(docs, "shard_order")))

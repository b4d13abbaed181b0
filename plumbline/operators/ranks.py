"""Order statistics within groups of any size, by radix selection.

A double is mapped to a whole number of the same order, and its leading 16, 32, 48 and 64 bits are counted in turn. Each round counts, per
group, only the values that share the prefix found so far, so a round has at most 65,536 counts per wanted rank, however many rows
or values a group holds, and the number of rounds is fixed. Nothing is collected, no group is sorted, and no number of
slices is chosen: a hot group is spread over its prefixes in the joins and summed up before each shuffle.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

ROUNDS, BITS = 4, 16
FEW_ROWS = 1_000_000


def order_key(v):
    """The bits of a finite double as a whole number in the order of the values: sign, exponent, fraction. Equal only for equal values.

    The logarithm may be one off either way; what is left after dividing by that power of two then lies in [2, 4) or under 1, which moves the
    exponent by one. Under the least exponent nothing moves: subnormal numbers and zero. The text is kept short, as long ones run uncompiled.
    """
    size = F.abs(v)
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)).cast("int")
    # dividing by a power of two, taking away one and scaling lose nothing
    left = size / F.pow(F.lit(2.0), guess.cast("double"))
    past = F.when(left >= 2, left / 2).when((left < 1) & (guess > -1022), 2 * left - 2).otherwise(left - 1)
    bits = F.shiftleft((guess + 1023).cast("bigint"), 52) + (past * F.lit(2.0 ** 52)).cast("bigint")
    return F.when(v < 0, -bits).otherwise(bits)


def prefix(key, bits):
    return F.shiftright(key, 64 - bits) if bits < 64 else key


def select_ranks(counted, targets, by, begun=None, small=None):
    """Values at wanted ranks. ``counted`` has the columns ``by``, v and count (v null-free and finite, each once or more per group);
    ``targets`` has ``by``, target and rank (from 1). The result is ``by``, target, value; ranks beyond a group's count give no row.

    ``begun`` names the column of ``by`` that holds the leading BITS bits already. Where targets are few, ``small`` keeps the
    state of a round (a row per target), so that no round is run again for the next one; the last rounds become one once the prefixes found hold
    no more than FEW_ROWS rows together.
    """
    by = list(by)
    few = F.broadcast if small else lambda d: d
    # said to hold no null: else a filter for that is pushed below, which finds the key of every row once more and runs uncompiled
    keyed = counted.select(*by, "v", "count", F.coalesce(order_key(F.col("v")), F.lit(0).cast("bigint")).alias("_key"))
    state = targets.select(*by, "target", F.col("rank").cast("bigint").alias("_rank"), (F.col(begun) if begun else F.lit(0)).cast("bigint").alias("_at"))
    known = BITS if begun else 0
    while known < ROUNDS * BITS:
        found, known = known, known + BITS
        if small and found > (BITS if begun else 0):
            inside = state.groupBy(*by, "_at").agg(F.first("_rows").alias("n")).agg(F.sum("n").alias("n")).first()["n"]
            known = ROUNDS * BITS if (inside or 0) <= FEW_ROWS else known
        live = keyed.withColumns({"_at": prefix(F.col("_key"), found) if found else F.lit(0).cast("bigint"), "_to": prefix(F.col("_key"), known)})
        if found:
            live = live.join(few(state.select(*by, "_at").distinct()), [*by, "_at"])
        held = live.groupBy(*by, "_at", "_to").agg(F.sum("count").alias("_held"), F.min("v").alias("_v"), F.count(F.lit(1)).alias("_rows"))
        running = Window.partitionBy(*by, "_at").orderBy("_to")
        placed = held.withColumn("_upto", F.sum("_held").over(running))
        state = placed.join(few(state.select(*by, "target", "_rank", "_at")), [*by, "_at"]).where("_rank <= _upto AND _rank > _upto - _held").select(
            *by, "target", (F.col("_rank") - F.col("_upto") + F.col("_held")).alias("_rank"), F.col("_to").alias("_at"), "_v", "_rows")
        state = small(state) if small else state
    return state.select(*by, "target", F.col("_v").alias("value"))


def middle_ranks(sizes, by, n="n"):
    """Targets of the median: the two middle ranks, which are one rank where the count is odd."""
    both = F.array(F.expr(f"({n} + 1) div 2"), F.expr(f"{n} div 2 + 1"))
    return sizes.select(*by, F.posexplode(both).alias("target", "rank"))


def medians(rows, by, stored=lambda d: d):
    """``by``, value: the exact median of v per group. ``stored`` may keep the value counts, which every round reads."""
    by = list(by)
    counted = stored(rows.where("v IS NOT NULL").groupBy(*by, "v").count())
    sizes = counted.groupBy(*by).agg(F.sum("count").alias("n"))
    return select_ranks(counted, middle_ranks(sizes, by), by).groupBy(*by).agg(F.avg("value").alias("value"))

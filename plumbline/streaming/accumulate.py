"""A table that grows by batches, analysed from state that merges.

Each batch leaves its rows and its state under its own number, so a batch that is delivered again replaces itself and batches may come
in any order. The state of a batch is what its new rows (those no other batch holds) add: null counts and extremes per column,
sums of powers about the batch's own mean, sums of products about fixed shifts with the incomplete pairs kept apart, counts of values,
and counts between fixed cuts (leading bits of the value), which tell in which cell a quantile lies. Merged, they give
gates, moments, quantiles, modes and correlations exactly, medians filled in for nulls included, without reading rows again. Lines and
outliers depend on the place of rows in the whole and on its final fences, so they read the accumulated rows.

Which columns are blocked decides what is trimmed and compared. The derived state is kept per such choice; where a later batch changes it, the
state of all batches is derived anew from their stored rows, once.
"""

import hashlib
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.expr import col, numbers, numeric_columns, text_columns
from plumbline.functions.store import local
from plumbline.operators import clean, gates, profile, roles, stats
from plumbline.operators.assoc import finished_pairs
from plumbline.operators.ranks import BITS, middle_ranks, order_key, prefix, select_ranks
from plumbline.plans.analysis import Known, Report, Sections, numeric_sections

def _cell():
    """A value's leading bits: the fixed cut that it lies behind."""
    return prefix(order_key(F.col("v")), BITS)


class Accumulated:
    """The table in ``folder`` (on storage that all executors share) and its reports."""

    def __init__(self, spark, folder, order_by, combined=False):
        self.spark, self.folder, self.order_by, self.combined = spark, folder.rstrip("/"), list(order_by), combined

    # storage

    def _batches(self, kind):
        """Numbers of the batches whose ``kind`` is completely written."""
        done = [p.getParent().getName() for p in self._files(f"{self.folder}/{kind}/batch=*/_SUCCESS")]
        return sorted(int(n.split("=")[1]) for n in done)

    def _write(self, df, kind, number):
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={number}")

    def _read(self, kind, numbers):
        """``kind`` of these batches, with the column batch."""
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/batch={n}" for n in numbers])

    # arrival

    def add(self, batch, number):
        """Store a batch under its number, in place of what that number held."""
        self._write(batch, "rows", number)
        stored = self._read("rows", [number]).drop("batch")
        self._write(gates.column_facts(stored), "gates", number)
        self._forget(number)

    def _forget(self, number):
        """Mark what was derived from an earlier batch of that number as missing; the next report derives it anew."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for found in self._files(f"{self.folder}/derived-*/rows/batch={number}"):
            found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop(found, "_SUCCESS"), False)

    def _files(self, pattern):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        return [s.getPath() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []]

    def rows(self):
        """All rows as they came."""
        return self._read("rows", self._batches("rows")).drop("batch")

    def _column_facts(self):
        return local(gates.merged_column_facts(self._read("gates", self._batches("gates"))))

    def _choice(self, df, facts):
        """The columns blocked so far, and the folder of the state derived with them; None while the table as a whole is blocked."""
        if gates.dataset_gates(df, self.combined, facts).where("status = 'BLOCK'").count():
            return None
        blocked = [r["column"] for r in gates.column_gates(df, facts=facts).where("status = 'BLOCK'").select("column").collect()]
        return blocked, "derived-" + hashlib.sha256(repr((df.schema.simpleString(), sorted(blocked))).encode()).hexdigest()[:16]

    def _derive(self, choice, number):
        """The state that a batch's new rows add."""
        blocked, folder = choice
        raw = self._read("rows", [number]).drop("batch")
        tidy = clean.trim_strings(clean.sanitise(raw), blocked)
        keyed = tidy.withColumn("_digest", F.unhex(F.sha2(F.to_json(F.struct(*[col(c) for c in tidy.columns])), 256)))
        # rows with one digest are the same in all columns; grouped by all they need no sort, but not every type can be grouped
        nested = any(word in f.dataType.simpleString() for f in tidy.schema.fields for word in ("map<", "variant"))
        keyed = keyed.dropDuplicates(["_digest"] if nested else None)
        others = [n for n in self._batches(f"{folder}/rows") if n != number]
        if others:
            keyed = keyed.join(self._read(f"{folder}/rows", others).select("_digest"), "_digest", "left_anti").select(keyed.columns)
        self._write(keyed, f"{folder}/rows", number)
        new = self._read(f"{folder}/rows", [number]).drop("batch", "_digest")
        numeric = [c for c in numeric_columns(new) if c not in blocked]
        if not numeric:
            return
        self._write(stats.facts(new, numeric, powers=True), f"{folder}/moments", number)
        plain = numbers(new, numeric)
        counted = plain.unpivot([], numeric, "column", "v").where("v IS NOT NULL").groupBy("column", "v").count().withColumn("cell", _cell())
        self._write(counted, f"{folder}/values", number)
        values = self._read(f"{folder}/values", [number])
        self._write(values.groupBy("column", "cell").agg(F.sum("count").alias("count")), f"{folder}/cells", number)
        if len(numeric) > 1:
            self._write(pair_sums(plain, numeric, self._shifts(folder, number)), f"{folder}/pairs", number)

    def _shifts(self, folder, number):
        """{column: number near its mean}: the means of the first batch derived, and the same for all later ones."""
        first = self._batches(f"{folder}/shifts")
        if not first:
            means = self._read(f"{folder}/moments", [number]).select("column", F.coalesce("mean", F.lit(0.0)).alias("shift"))
            self._write(means, f"{folder}/shifts", 0)
        return {r["column"]: r["shift"] for r in self._read(f"{folder}/shifts", [0]).collect()}

    # reports

    def report(self, label="table", test="moments"):
        """The analysis of all rows so far."""
        df, facts = self.rows(), self._column_facts()
        gate_rows, column_rows = gates.dataset_gates(df, self.combined, facts), gates.column_gates(df, facts=facts)
        tables = Sections(gates=lambda: gate_rows, columns=lambda: column_rows,
                          trace=lambda: gates.gate_trace(df, label, self.combined, facts).select("step", "status", "detail"))
        choice = self._choice(df, facts)
        if choice is None:
            stopped = gate_rows.where("status = 'BLOCK'").orderBy("position").select("reason").first()
            return Report(label, "BLOCKED", stopped["reason"], tables=tables)
        blocked, folder = choice
        derived = set(self._batches(f"{folder}/rows"))
        for number in self._batches("rows"):
            if number not in derived:
                self._derive(choice, number)
        every = self._batches(f"{folder}/rows")
        unique = self._read(f"{folder}/rows", every).drop("batch", "_digest")
        merged = Merged(self, folder, every, [c for c in numeric_columns(unique) if c not in blocked])
        plan = merged.fill_plan() + self._text_plan(unique, blocked, merged.rows)
        cleaned = clean.apply_fill(unique, plan)
        ready = roles.promote_dates(cleaned, [c for c in text_columns(cleaned) if c not in blocked])
        found = roles.classify(ready, blocked)
        tables.add(cleaned=lambda: ready, completeness=lambda: profile.completeness(ready))
        if found.numeric:
            known = Known(ready, found.numeric, self.order_by, given=merged.known(found.numeric))
            tables.add(**numeric_sections(known, test, (found.date or [None])[0]))
        if found.categorical:
            tables.add(categories=lambda: stats.category_profile(ready, found.categorical))
        return Report(label, "OK", None, found, blocked, tables)

    def _text_plan(self, unique, blocked, rows):
        """Fills of the columns that are not numbers, by their most frequent value."""
        others = [c for c in unique.columns if c not in blocked and c not in numeric_columns(unique)]
        return clean.fill_plan(unique, others) if others else []


def pair_sums(plain, columns, shift):
    """Per pair the sums about the shifts over rows that hold both values, the first only, the second only, and the count of neither."""
    frames = []
    for part in stats.chunks(list(combinations(columns, 2)), 12):
        rows = []
        for a, b in part:
            x, y = col(a) - F.lit(shift[a]), col(b) - F.lit(shift[b])
            no_x, no_y = col(a).isNull(), col(b).isNull()
            none = F.lit(0.0)
            rows.append(F.struct(
                F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.lit(shift[a]).alias("c1"), F.lit(shift[b]).alias("c2"),
                F.count(x * y).alias("n"), F.count(F.when(no_y, x)).alias("n_x"), F.count(F.when(no_x, y)).alias("n_y"), F.count(F.when(no_x & no_y, 1)).alias("n_none"),
                *[F.coalesce(F.sum(v), none).alias(k) for k, v in (
                    ("sx", F.when(~no_y, x)), ("sy", F.when(~no_x, y)), ("sxy", x * y), ("sxx", F.when(~no_y, x * x)), ("syy", F.when(~no_x, y * y)),
                    ("only_x", F.when(no_y, x)), ("only_y", F.when(no_x, y)), ("only_xx", F.when(no_y, x * x)), ("only_yy", F.when(no_x, y * y)))]))
        frames.append(plain.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*"))
    return stats.union_all(frames)


class Merged:
    """Facts of all new rows together, with nulls filled by the median."""

    def __init__(self, table, folder, batches, numeric):
        self.table, self.folder, self.batches, self.numeric = table, folder, batches, numeric
        self.parts = self._all("moments") if numeric else None
        totals = {} if not numeric else {r["column"]: r for r in self.parts.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n")).collect()}
        self.rows = max((r["rows"] for r in totals.values()), default=0)
        self.count = {c: totals[c]["n"] for c in numeric}
        self.nulls = {c: totals[c]["rows"] - totals[c]["n"] for c in numeric}
        self.median = self._medians()

    def _all(self, kind):
        return self.table._read(f"{self.folder}/{kind}", self.batches)

    def _frame(self, rows, schema):
        return self.table.spark.createDataFrame(rows, schema)

    def _filled(self):
        """The filled nulls as value counts."""
        return [(c, self.median[c], self.nulls[c]) for c in self.numeric if self.nulls[c] and self.median[c] is not None]

    def _at(self, targets, fill=()):
        """{(column, target): value}: the cell of each rank from the counts between cuts, then the value from the counts of that cell."""
        cells, values = self._all("cells").drop("batch"), self._all("values").drop("batch")
        if fill:
            more = self._frame(list(fill), "column string, v double, count bigint").withColumn("cell", _cell())
            cells, values = cells.unionByName(more.drop("v")), values.unionByName(more)
        totals = cells.groupBy("column", "cell").agg(F.sum("count").alias("held"))
        upto = F.sum("held").over(Window.partitionBy("column").orderBy("cell"))  # at most 65,536 cells a column
        wanted = self._frame(targets, "column string, target int, rank bigint")
        placed = local(totals.withColumn("upto", upto).join(F.broadcast(wanted), "column").where("rank <= upto AND rank > upto - held").select(
            "column", "target", "cell", (F.col("rank") - F.col("upto") + F.col("held")).alias("rank")))
        inside = values.join(F.broadcast(placed.select("column", "cell").distinct()), ["column", "cell"])
        found = select_ranks(inside, placed, ["column", "cell"], "cell", local)  # a few targets a column
        return {(r["column"], r["target"]): r["value"] for r in found.collect()}

    def _medians(self):
        sizes = [(c, n) for c, n in self.count.items() if n]
        if not sizes:
            return {c: None for c in self.numeric}
        targets = [tuple(r) for r in middle_ranks(self._frame(sizes, "column string, n bigint"), ["column"]).collect()]
        found = self._at(targets)
        return {c: (found[c, 0] + found[c, 1]) / 2 if self.count[c] else None for c in self.numeric}

    def fill_plan(self):
        return [(c, "median", m, n, n / self.rows * 100) for c, m, n in self._filled()]

    def _sizes(self):
        filled = {c for c, *_ in self._filled()}
        return {c: self.rows if c in filled else self.count[c] for c in self.numeric}

    def facts(self):
        """Moments of the filled columns: parts about their own means are shifted to the common mean; the fill is one more part."""
        names = ("column", "n", "sum", "mean", "min", "max", "squares", "cubes", "fourths")
        fill = [(c, n, m * n, m, m, m, 0.0, 0.0, 0.0) for c, m, n in self._filled()]
        parts = self.parts.select(*names)
        if fill:
            parts = parts.unionByName(self._frame(fill, "column string, n bigint, " + ", ".join(f"{x} double" for x in names[2:])))
        known = parts.where("n > 0")
        whole = known.groupBy("column").agg(F.sum("n").alias("_n"), F.sum("sum").alias("_sum")).withColumn("_mean", F.col("_sum") / F.col("_n"))
        n, d = F.col("n"), F.col("mean") - F.col("_mean")
        s2, s3 = F.col("squares"), F.col("cubes")
        merged = known.join(F.broadcast(whole), "column").groupBy("column").agg(
            F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.first("_mean").alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
            F.sum(s2 + n * d * d).alias("squares"), F.sum(s3 + 3 * d * s2 + n * d * d * d).alias("cubes"),
            F.sum(F.col("fourths") + 4 * d * s3 + 6 * d * d * s2 + n * d * d * d * d).alias("fourths"))
        flat = F.col("min") == F.col("max")
        every = self._frame([(c, self.rows) for c in self.numeric], "column string, rows bigint").join(merged, "column", "left")
        return local(stats.shaped(every.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("squares", F.when(flat, 0.0).otherwise(F.col("squares")))))

    def quantiles(self):
        shares, sizes, targets = list(stats.QUANTILE_NAMES.values()), self._sizes(), []
        at = {}
        for c, n in sizes.items():
            for i, p in enumerate(shares if n else ()):
                low = int(p * (n - 1))
                at[c, i] = low, p * (n - 1) - low
                targets += [(c, 2 * i, low + 1), (c, 2 * i + 1, min(low + 2, n))]
        found = self._at(targets, self._filled()) if targets else {}
        return {c: [found[c, 2 * i] + (found[c, 2 * i + 1] - found[c, 2 * i]) * at[c, i][1] if n else None for i in range(len(shares))] for c, n in sizes.items()}

    def modes(self):
        values = self._all("values").select("column", "v", "count")
        if fill := self._filled():
            values = values.unionByName(self._frame(fill, "column string, v double, count bigint"))
        best = F.min(F.struct((-F.col("count")).alias("c"), F.col("v").alias("v")))
        found = values.groupBy("column", "v").agg(F.sum("count").alias("count")).groupBy("column").agg(best.alias("best"))
        return local(found.select("column", stats.rounded(F.col("best.v")).alias("mode"), (-F.col("best.c")).alias("mode_count")))

    def pairs(self, numeric, facts):
        """Pair facts of the filled columns: an absent value counts as the median."""
        if len(numeric) < 2:
            return None
        held = {r["column"]: r for r in facts.collect()}
        sums = self._all("pairs").groupBy("col1", "col2").agg(
            *[F.sum(c).alias(c) for c in ("n", "n_x", "n_y", "n_none", "sx", "sy", "sxy", "sxx", "syy", "only_x", "only_y", "only_xx", "only_yy")],
            F.first("c1").alias("c1"), F.first("c2").alias("c2"))
        filled = [(c, self.median[c] if c in {f[0] for f in self._filled()} else None, held[c]["min"] == held[c]["max"]) for c in numeric]
        named = lambda at: F.broadcast(self._frame(filled, f"col{at} string, m{at} double, flat{at} boolean"))
        x, y = F.col("m1") - F.col("c1"), F.col("m2") - F.col("c2")
        add = lambda value, times: F.coalesce(value * times, F.lit(0.0))
        both, only_x, only_y = (F.col("m1").isNotNull() & F.col("m2").isNotNull()), F.col("m2").isNotNull(), F.col("m1").isNotNull()
        when = lambda c, v: F.when(c, v).otherwise(F.lit(0.0))
        wide = sums.join(named(1), "col1").join(named(2), "col2").select(
            "col1", "col2", "c1", "c2", (F.coalesce("flat1", F.lit(False)) | F.coalesce("flat2", F.lit(False))).alias("flat"),
            (F.col("n") + when(only_x, F.col("n_x")) + when(only_y, F.col("n_y")) + when(both, F.col("n_none"))).cast("double").alias("n"),
            (F.col("sx") + when(only_x, F.col("only_x")) + when(only_y, add(x, F.col("n_y"))) + when(both, add(x, F.col("n_none")))).alias("sx"),
            (F.col("sy") + when(only_y, F.col("only_y")) + when(only_x, add(y, F.col("n_x"))) + when(both, add(y, F.col("n_none")))).alias("sy"),
            (F.col("sxx") + when(only_x, F.col("only_xx")) + when(only_y, add(x * x, F.col("n_y"))) + when(both, add(x * x, F.col("n_none")))).alias("sxx"),
            (F.col("syy") + when(only_y, F.col("only_yy")) + when(only_x, add(y * y, F.col("n_x"))) + when(both, add(y * y, F.col("n_none")))).alias("syy"),
            (F.col("sxy") + when(only_x, add(y, F.col("only_x"))) + when(only_y, add(x, F.col("only_y"))) + when(both, add(x * y, F.col("n_none")))).alias("sxy"))
        return local(finished_pairs(wide))

    def known(self, numeric):
        facts = local(self.facts().where(F.col("column").isin(numeric)))
        quantiles = {c: v for c, v in self.quantiles().items() if c in numeric}
        given = {"facts": facts, "quantiles": quantiles, "modes": local(self.modes().where(F.col("column").isin(numeric)))}
        pairs = self.pairs(numeric, facts)
        return given | ({"pairs": pairs} if pairs is not None else {})

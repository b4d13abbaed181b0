"""URL rules by host suffix and path prefix, matched through short hash prefixes.

Each URL is expanded into the host-suffix and path-prefix expressions that can meet a rule: for every (host length, path length)
that occurs among the rules, the end of the host at a label boundary and the start of the path. Expressions join the rules on the
first 8 hex digits of their SHA-256; full digests confirm. Of the rules that fit, the longest text wins, then the longer host, then
block before allow. No rule: `default`. The rule side is joined without a hint, so Spark broadcasts it only if it is small.

Null urls and urls without `://` have empty host and path, which no rule fits. Rows may repeat: each gives its own row, whatever
its page_id. An empty table gives an empty result, no rules give `default` everywhere.
Other columns are not read, whatever their names. A very long url is read whole, in memory in proportion to that one url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import column, query, table

RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _expressions(pairs) -> Column:
    """What of a URL (columns host, path) the rules of these lengths could match."""
    listed = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in pairs])
    def one(pair):
        longer = F.length("host") - pair["h"]
        fits = (longer == 0) | ((longer > 0) & (F.substring(F.col("host"), longer, F.lit(1)) == "."))
        text = F.concat(F.right(F.col("host"), pair["h"]), F.left(F.col("path"), pair["p"]))
        return F.when(fits & (F.length("path") >= pair["p"]), F.struct(pair["h"].alias("h"), text.alias("text")))
    return F.filter(F.transform(listed, one), lambda x: x.isNotNull())


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row. `rules` has verdict, host, path."""
    rules = rules.filter("host <> ''").dropDuplicates()
    pairs = sorted({tuple(r) for r in rules.select(F.length("host"), F.length("path")).distinct().collect()})
    host, path = url_parts(column(pages, url, "string"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), column(pages, page_id, "long").alias("page_id"),
                        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    if not pairs:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    found = rows.select("*", F.explode_outer(_expressions(pairs)).alias("expression"))
    found = found.withColumn("digest", F.sha2("expression.text", 256)).withColumn("short", F.left(F.col("digest"), F.lit(SHORT)))
    text = F.concat("host", "path")
    listed = rules.select(
        F.struct(F.length(text).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").cast("int").alias("b"),
                 text.alias("rule"), F.col("verdict")).alias("hit"),
        F.left(F.sha2(text, 256), F.lit(SHORT)).alias("short"), F.sha2(text, 256).alias("rule_digest"))
    hits = found.join(listed, "short", "left")
    # The whole digest and the rule's own host length must agree, not the short prefix alone.
    sure = (F.col("digest") == F.col("rule_digest")) & (F.col("expression.h") == F.col("hit.h"))
    best = hits.groupBy("rid").agg(F.first(F.struct("page_id", "host", "path")).alias("row"), F.max(F.when(sure, F.col("hit"))).alias("hit"))
    return best.select("row.*", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark, lines=RULES) -> DataFrame:
    """Rules written as `verdict host/path`."""
    split = [(verdict, *rule.partition("/")) for verdict, rule in (line.split(" ", 1) for line in lines)]
    return spark.createDataFrame([(v, h, s + p) for v, h, s, p in split], "verdict string, host string, path string")


@query("op10_url_filter", f"""
WITH r AS (SELECT split_part(x, ' ', 1) AS verdict, split_part(x, ' ', 2) AS rule, split_part(split_part(x, ' ', 2), '/', 1) AS host,
                  substr(x, strpos(x, '/')) AS path FROM (SELECT unnest({list(RULES)!r}) AS x)),
u AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rid, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, rid, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.rid, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)""")
def op10_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark))

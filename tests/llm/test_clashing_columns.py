"""Every query gives the same rows where its tables carry further columns that are named as the operators' own, and takes a very long text whole."""

import pytest

from plumbline.llm import queries

#: Names that the operators use inside, or return.
NAMES = ("row", "rid", "key", "cell", "fp", "y", "piece", "kept", "uid", "sha", "score", "size", "body", "part", "mask", "n", "column", "value", "node", "depth", "shard", "host", "path", "count")
#: Where a result may hold any number.
FREE = {"op4_best_fit_packing": ("sequence_id", "offset"), "pipeline": ("sequence_id", "offset")}


@pytest.fixture(scope="module")
def folders(spark, prose, tmp_path_factory):
    texts = [prose(i, 60 + i % 40) for i in range(60)] + ["", None, prose(1, 61), prose(2, 62) + " end", prose(900, 30_000), " ".join([prose(901, 1)] * 20_000)]
    docs = [(i, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(5, 70), "en", "s", 1), (3, texts[3], "en", "s", 1)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, prose(7, 67)[:200]), (2, None), (2, "short one")], "item_id long, text string"),
        "pages": ([(i, f"https://a{i % 3}.example.{('org', 'com')[i % 2]}/{('es', 'fr', 'en/1')[i % 3]}/{i}", f"<nav>m</nav><article><p>{t}</p></article>") for i, t in enumerate(texts[:30])] + [(None, None, None)],
                  "page_id long, url string, html string"),
        "conversations": ([(i % 12, i // 12, ("user", None)[i % 2], texts[i % 9]) for i in range(70)] + [(None, 1, "user", "x")], "conv_id long, turn long, role string, text string"),
    }
    tops = {}
    for kind in ("plain", "wide"):
        tops[kind] = str(tmp_path_factory.mktemp(kind))
        for name, (rows, schema) in tables.items():
            df = spark.createDataFrame(rows, schema).coalesce(1)
            more = [f"CAST(NULL AS STRING) AS `{n}`" if k % 2 else f"map('a', {k}) AS `{n}`" for k, n in enumerate(NAMES) if kind == "wide" and n not in df.columns]
            df.selectExpr("*", *more).write.parquet(f"{tops[kind]}/{name}.parquet")
    return tops


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_further_columns_change_nothing(spark, folders, name):
    rows = {}
    for kind, top in folders.items():
        found = queries.QUERIES[name](spark, top).drop(*FREE.get(name, ()))
        rows[kind] = found.columns, sorted(str(r) for r in found.collect())
    assert rows["plain"] == rows["wide"] and rows["plain"][1]

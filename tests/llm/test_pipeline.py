import pytest

import corpus_pipeline
from plumbline.llm import decontaminate, exact_dedup, quality, simhash


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    junk = lambda i: " ".join([prose(i, 1)] * 50)
    rows = [(i, junk(i) if i % 6 == 0 else prose(i, 40 + i % 30), "en", "s", 1) for i in range(200)]
    leak = prose(7000, 25)
    rows += [(300, rows[1][1], "en", "s", 1), (301, rows[1][1] + " ", "en", "s", 1), (302, rows[2][1], None, None, None), (303, prose(303, 30) + " " + leak, "en", "s", 1), (304, None, "en", "s", 1)]
    rows += [(305, " ".join([prose(3, 120), "end"]), "en", "s", 1), (306, " ".join([prose(3, 120), "fin"]), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(200)], "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        after.write.parquet(f"{folder}/stage{k}")
        seen[name] = (ids(docs), ids(after))
        docs = spark.read.parquet(f"{folder}/stage{k}")
    junk = {i for i in range(200) if i % 6 == 0}
    gone = {name: set(a) - set(b) for name, (a, b) in seen.items()}
    assert gone["quality"] == junk
    assert gone["exact_dedup"] == {1, 300, 302}  # 301 has one code point more than 1 and 300
    assert len(gone["near_dedup"] & {305, 306}) == 1 and not gone["near_dedup"] - {305, 306}
    assert gone["decontaminate"] == {303}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted({r.doc_id for r in packed}) == seen["decontaminate"][1]
    run = corpus_pipeline.run(spark, folder)
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert run.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and key(run.collect()) == key(packed)


def test_stages_call_the_operators():
    used = {corpus_pipeline.quality: quality.keep_good, corpus_pipeline.exact_dedup: exact_dedup.deduplicate, corpus_pipeline.simhash: simhash.drop_near_duplicates, corpus_pipeline.benchmark_passages: decontaminate.decontaminate}
    assert len(used) == 4 and [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]

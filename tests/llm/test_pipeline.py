import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid
from tests.llm.test_decontaminate import plain as plain_matches
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_components

SYLLABLES = {"aa": ["ba", "ko", "mi", "tu", "la"], "bb": ["zsch", "urg", "ein", "ock", "wer"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)

    def words(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))

    items = [(i, words("aa", 20)) for i in range(5)]
    shared = [words("aa", 12) for _ in range(4)]
    docs = [(0, "12345 ??", "aa"), (1, None, "aa"), (2, "", "bb")]
    for i in range(3, 150):
        lang = "aa" if i % 2 else "bb"
        text = "\n".join([words(lang, rng.randrange(10, 120)), *rng.sample(shared, i % 3), words(lang, 30)])
        docs.append((i, text + (" " + items[i % 5][1] if i % 10 == 3 else ""), lang))
    docs += [(1000 + i, t, None) for i, t, _ in docs[20:40]] + [docs[50]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_equals_plain_stages(spark, folder):
    path, docs, items = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    classify = langid.classifier(langid.fit(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    rows = [(i, t) for i, t, _ in docs if not classify(t)[2]]
    assert 120 < len(rows) < len(docs)
    rows = [(i, t) for i, _, _, t in plain_lines(rows)]
    firsts = {c for _, _, c in plain_components(rows)}
    rows = [(i, t) for i, t in {i: t for i, t in rows}.items() if i in firsts]
    leaks = {m[0] for m in plain_matches(rows, items)}
    assert leaks
    rows = [(i, t) for i, t in rows if i not in leaks]
    found = corpus_pipeline.run(spark, path).collect()
    check(found, rows, 1024)


def test_stages_return_the_columns_of_documents_and_take_empty_tables(spark, folder):
    path, docs, _ = folder
    frame = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, path)
        assert out.count() == 0
        assert name == "best-fit packing" or out.columns == frame.columns


def test_null_ids_are_judged_by_text(spark, folder):
    path, _, items = folder
    frame = spark.createDataFrame([(None, "x " + items[0][1], 1), (None, "clean text here", 2)], "doc_id long, text string, extra int")
    assert [r.extra for r in corpus_pipeline.decontamination(spark, frame, path).collect()] == [2]
    assert corpus_pipeline.near_dedup(spark, frame, path).count() == 2


def test_clashing_columns_and_nulls_pass_through(spark, folder):
    path, docs, _ = folder
    extra = {"score": F.lit("mine"), "kept": F.lit(7), "_key": F.col("doc_id") + 1, "row": F.lit(None).cast("string"), "rest": F.lit(2.5), "fp": F.array(F.lit(1))}
    frame = spark.read.parquet(f"{path}/documents.parquet").withColumns(extra).withColumn("n_chars", F.lit(None).cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, path)
        assert out.columns == frame.columns
        rows = out.collect()
        assert rows and all((r.score, r.kept, r._key, r.row, r.rest, r.fp) == ("mine", 7, r.doc_id + 1, None, 2.5, [1]) for r in rows), name

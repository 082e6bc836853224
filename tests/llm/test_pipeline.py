"""The pipeline on a small corpus: columns, decisions stage by stage, and the whole run."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices(["tion", "ar", "be", "lon", "mi", "sta", "re", "du"], k=rng.randint(2, 4)))
    docs, labels = [], []
    for i in range(120):
        words = [word() for _ in range(60)]
        text = " ".join(w.upper() + "!!" for w in words) if i % 6 == 0 else " ".join(words)
        if i % 10 == 1:
            text += "\nA line that many documents share"
        if i % 20 == 3:
            text += " " + PASSAGE
        docs.append((i, text, "en", f"src{i % 3}", len(text), "own"))
        labels.append((i, int(i % 6 != 0), 0))
    docs += [(500, docs[2][1] + " tail", "en", "src0", 9, "own"), (501, None, "en", None, None, "own"), (502, docs[4][1], "en", "src1", 9, "own")]
    path = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long, {} string"
    spark.createDataFrame(docs, schema.format("kept")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_stages(spark, place):
    path, rows = place
    docs = spark.read.parquet(f"{path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    seen = {r.doc_id: r for r in pipeline.line_dedup(spark, docs, path).collect()}
    assert "A line that many" in seen[111].text and "A line that many" not in seen[1].text and seen[1].n_chars == len(seen[1].text)
    assert seen[2].text == text[2] and seen[501].text is None and seen[501].n_chars is None
    near = {r.doc_id for r in pipeline.minhash_near_dedup(spark, docs, path).collect()}
    assert near == set(text) - {500, 502}
    clean = {r.doc_id for r in pipeline.benchmark_decontamination(spark, docs, path).collect()}
    assert clean == {i for i in text if PASSAGE not in (text[i] or "")}
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    mixed = pipeline.source_mixing(spark, docs, path)
    assert mixed.columns == [*docs.columns, "pass", "words", "position"]


def test_run(spark, place):
    path, rows = place
    out = entry.queries()["pipeline"](spark, path).collect()
    ids = {r.doc_id for r in out}
    good = {i for i in range(120) if i % 6 and i % 20 != 3}
    assert ids <= set(r[0] for r in rows) and len(good - ids) < 0.5 * len(good)
    assert not ids & {i for i in range(120) if i % 20 == 3} and not ids & {500, 502}
    assert len(ids & {i for i in range(120) if i % 6 == 0}) <= 2
    assert [r.position for r in out] == sorted(r.position for r in out)

"""The pipeline's stages against brute force on a small fixture."""

import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    rows = {i: text(60) for i in range(90)}
    toxic = {i for i in range(0, 90, 3)}
    for i in toxic:
        rows[i] += " vile nasty"
    rows[100], rows[101] = rows[1], rows[2] + " end"  # copies
    rows[102] = text(40) + " " + item + " " + text(40)
    rows[103], rows[104] = text(50) + "\na line of its own here", text(50) + "\nA line of its own here"
    rows[105] = None
    rows[106] = "A LINE of its own here"  # nothing else: line dedup empties it
    rows[107] = ""
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows.items()] + [(None, t, "en", "s", 1) for t in ("no id", "no id", text(9) + " " + item, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {*rows} - toxic, rows


def test_stages(spark, folder):
    path, clean, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen, nameless = [], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        got = docs.collect()
        seen.append({r.doc_id: r.text for r in got if r.doc_id is not None})
        nameless.append(sorted(r.text or "" for r in got if r.doc_id is None))
    assert set(seen[0]) == clean and len(nameless[2]) == 4 and nameless[3] == ["", "no id", "no id"]
    # equal lines go: 100 and 106 have nothing else, 105 and 107 were empty before
    clean = clean - {100, 106}
    assert seen[1][103].endswith("own here") and seen[1][104] == rows[104].split("\n")[0] and set(seen[1]) == clean
    assert set(seen[2]) == clean - {101} and set(seen[3]) == clean - {101, 102}
    out = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in out.collect()} == {*seen[3], None} and out.count() == len(seen[3]) + 3


def test_stages_of_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

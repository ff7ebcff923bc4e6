"""The pipeline: stages in order, columns kept, decisions that took effect."""

import corpus_pipeline as C
from siltweb.llm import mixing, near_dedup, packing, pii


def test_stages_on_planted_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    base = docs.where("lang = 'en' and n_chars > 900").orderBy("doc_id").first()
    extra = [
        (10_001, base["text"], "en", "src1", 0),
        (10_002, base["text"] + " again", None, "src1", 0),
        (10_003, "12345 !!", "en", "src1", 0),
        (10_004, None, "en", "src1", 0),
        (10_005, "Write to some.one@example.com about the house and the garden of it.", "en", "src2", 0),
        (10_005, "Write to some.one@example.com about the house and the garden of it.", "en", "src2", 0),
    ]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).persist()
    at = {}
    now = docs
    for name, stage in C.STAGES[:-1]:
        now = stage(spark, now, small)
        assert now.columns == docs.columns
        at[name] = now = spark.createDataFrame(now.collect(), now.schema)
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in at.items()}
    assert 10_003 not in ids["language_id"] and 10_004 not in ids["language_id"] and 10_002 in ids["language_id"]
    assert not {10_001, 10_002} & set(ids["near_dedup"]) and base["doc_id"] in ids["near_dedup"]
    assert ids["near_dedup"].count(10_005) == 1
    text = at["pii"].where("doc_id = 10005").first()["text"]
    assert text == "Write to [EMAIL] about the house and the garden of it."
    assert all(not pii.base_spans(r["text"]) for r in at["pii"].collect())
    assert sorted(ids["pii"]) == sorted(ids["near_dedup"]) and set(ids["mixing"]) < set(ids["pii"])
    packed = C.pack_sequences(spark, at["mixing"], small).collect()
    assert {r["doc_id"] for r in packed} == set(ids["mixing"])


def test_run_gives_pieces(spark, small):
    out = C.run(spark, small)
    assert out.columns == packing.pack(spark.read.parquet(f"{small}/documents.parquet")).columns
    assert out.count() > 0
    assert [name for name, _ in C.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    assert mixing and near_dedup


def test_null_and_repeated_ids_keep_their_other_texts(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (None, a), (None, c), (None, d), (None, d), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in C.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (None, c), (None, d), (8, None)], key=str)

import os
from collections import Counter

import corpus_pipeline
from sparkloom.llm import queries


def test_stages_keep_columns_and_their_decisions_hold(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing sources", "packing"]
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    mixed = spark.read.parquet(str(tmp_path / "3"))
    tokens = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in tokens) <= 2048
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}


def test_near_stage_against_brute_force(spark, data, documents):
    from test_near_dedup import expected

    docs = spark.read.parquet(f"{data}/documents.parquet")
    table = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, data).collect()}
    assert kept == {d for d, _, _, k in expected(table, 80) if k}


def test_run_gives_pieces(spark, data):
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, data).columns)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_sequences_hold_the_mix(spark, data, tmp_path):
    """Every sequence can be made from the result, and holds the tokens of its documents and nothing else."""
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, data)
    out.write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    made = corpus_pipeline.sequences(out).collect()
    assert all(len(r.ids) == 4 * r.length <= 4 * 2048 for r in made)
    assert sum(r.length for r in made) == out.agg({"length": "sum"}).first()[0]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    reader = Tokenizer.from_file(queries.byte_level())
    for r in out.filter("start = 0 AND length = doc_tokens").limit(40).collect():
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert ids[-1] == 1 and texts[r.doc_id].startswith(reader.decode(ids[:-1], skip_special_tokens=False))


def run_on(spark, tmp_path, rows, extra=False):
    folder = str(tmp_path / f"t{len(os.listdir(tmp_path))}")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("size", "score", "node", "row", "_c0", "_row", "_bucket", "_key", "ids", "start", "first", "keys", "label", "content"):
            docs = docs.selectExpr("*", f"'x' AS `{name}`")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, folder).collect()


def test_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 12]), "en", "ab"[i % 2], 60) for i in range(0, 200, 20)]
    rows += [(0, rows[0][1], "en", "a", 60)] * 3 + [(None, None, None, None, None), (7, "", "en", "a", 0), (None, "no id at all here now", None, None, None)]
    rows += [(900, " ".join(f"long{i}" for i in range(20_000)), "en", "b", 1)]
    out = run_on(spark, tmp_path, rows, extra=True)
    seen = Counter(r.doc_id for r in out if r.start == 0)
    assert seen[0] <= 3 and {20, 40, 60, 900, None} <= set(seen)
    assert max(Counter((r.sequence_id, r.offset) for r in out).values()) == 1
    assert sum(r.length for r in out if r.doc_id == 900) >= 20_000


def test_empty_table(spark, tmp_path):
    assert run_on(spark, tmp_path, []) == []

"""Each stage of the pipeline on its own input against a brute-force version."""

import re
from collections import Counter


import __spark_entry__ as entry

import corpus_pipeline as pipeline
from panelloom.llm import mixing
from panelloom.llm.common import with_stored_position

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = pipeline.keep_quality(spark, docs, SF)
    assert out.columns == columns
    kept = {r.doc_id for r in out.collect()}
    right = [(d in kept) == (q == 1) for d, q in quality.items()]
    assert sum(right) / len(right) > 0.95

    out = pipeline.drop_copies(spark, docs, SF)
    best = {}
    for d, r in rows.items():
        key = (r.text or "").translate(UP)
        best[key] = max(d, best.get(key, d))
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(best.values())

    sets = {}
    for d, r in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(UP))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    out = pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(d for d in rows if find(d) == d)

    out = pipeline.mix_sources(spark, docs, SF)
    assert out.columns == columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, rows.values()))

    packed = pipeline.pack_sequences(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(rows)
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in packed)


def test_run_gives_the_last_stage_of_what_all_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    want = sorted((r.doc_id, r.start, bytes(r.ids)) for r in docs.collect())
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in pipeline.run(spark, SF).collect()) == want


def test_sequences_follow_the_mix(spark, monkeypatch):
    """Ids of each bucket against the positions of mix(), for run() and for stages that are not stored between."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(pipeline, "STAGES", pipeline.STAGES[3:])
    for out in (pipeline.run(spark, SF), pipeline.pack_sequences(spark, pipeline.mix_sources(spark, docs, SF), SF)):
        rows = sorted(out.collect(), key=lambda r: r.sequence_id)
        order = [(r.bucket, place[r.doc_id], r.start) for r in rows]
        assert order == sorted(order) and len({r.sequence_id for r in rows}) == len(rows)
        assert {r.doc_id for r in rows} == set(place) and all(r.sequence_id >> 57 == r.bucket for r in rows)


def test_stored_position_is_the_order_of_the_files(spark, tmp_path):
    """Files grow, and readers take the largest first."""
    df = spark.range(10_000).selectExpr("id", "repeat(cast(id as string), cast(id div 1000 as int)) AS t", "id AS _file")
    df.repartitionByRange(12, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "x"))
    stored = spark.read.parquet(str(tmp_path / "x"))
    assert len(stored.inputFiles()) == 12
    got = with_stored_position(stored, "p")
    assert got.columns == ["id", "t", "_file", "p"] and got.where("p <> id").count() == 0 and got.count() == 10_000
    assert with_stored_position(spark.range(0), "p").collect() == []


def test_registered_queries_have_their_operators():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {"op1_chat_format", "op4_warc", "op5_exact_dedup"} <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()

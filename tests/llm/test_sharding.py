import zlib

from pyspark.sql import functions as F

from storelens.llm import sharding as S

from .helpers import frame, rows_of


def laws(got, n=8):
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(n)]
    return sizes


def test_even_bytes_and_gapless_slots(spark):
    docs = [(i, "w" * (i % 97) + str(i)) for i in range(4000)] + [(9000, None), (9001, ""), (None, "z")]
    got = S.assign_shards(frame(spark, docs)).collect()
    sizes = laws(got)
    mean = sum(sizes) / 8
    assert len(got) == len(docs) and max(abs(s - mean) for s in sizes) <= 2 * S.TOLERANCE * mean + 200
    by = {r.doc_id: r for r in got}
    assert by[9000]["size"] == 1 and by[9001]["size"] == 1 and by[5]["size"] == len("w" * 5 + "5") + 1
    assert by[5].text_crc32 == zlib.crc32(("w" * 5 + "5").encode())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = {(r.doc_id, r.shard, r.slot) for r in S.assign_shards(frame(spark, docs, 7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_small_groups_of_copies_stay_together(spark):
    docs = [(i, f"text {i // 3} " + "v" * (i // 3 % 50)) for i in range(6000)]
    shards = {}
    for r in S.assign_shards(frame(spark, docs)).collect():
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_one_text_with_a_third_of_all_rows_is_split(spark):
    docs = [(i, "hot " * 20 if i % 3 == 0 else f"cold {i} " + "c" * 70) for i in range(6000)]
    sizes = laws(S.assign_shards(frame(spark, docs)).collect())
    mean = sum(sizes) / 8
    assert max(abs(s - mean) for s in sizes) <= 2 * S.TOLERANCE * mean + 200


def test_ties_and_empty_table(spark):
    laws(S.assign_shards(frame(spark, [(1, "same")] * 40)).collect())
    assert rows_of(S.assign_shards(frame(spark, []))) == []
    assert len(rows_of(S.assign_shards(frame(spark, [(1, None)])))) == 1


def test_splitters_are_near_the_exact_ones(spark):
    keys = S.keyed(frame(spark, [(i, "t" * (i * 7 % 301)) for i in range(3000)])).cache()
    rows = sorted((r["__key"], r["size"]) for r in keys.collect())
    total = sum(s for _, s in rows)
    for i, s in enumerate(S.find_splitters(keys, 5, tolerance=0.0)):
        below = sum(size for k, size in rows if k < s)
        edges = [0]
        for _, size in rows:
            edges.append(edges[-1] + size)
        group_edges = min(abs(e - total * (i + 1) / 5) for e in edges)
        assert abs(below - total * (i + 1) / 5) == group_edges


def test_successor():
    assert S.successor("0a") == "0b" and S.successor("0f") == "1" and S.successor("ff") == "g"


def test_written_shards(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i}") for i in range(500)])
    S.write_shards(docs, str(tmp_path / "out"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.select(F.countDistinct("shard")).first()[0] == 4

import zlib

from pyspark.sql import functions as F

from bourseflow.llm.sharding import Settings, first_map, grown, newest, place, read_map, records, sharded, slot_bytes, write_map

from tests.llm.fixtures import awkward, docs_of, words


def test_near_equal_bytes_and_gapless_slots(spark):
    rows = [(i, words(i, 1 + i * 7 % 200)) for i in range(3000)]
    got = place(docs_of(spark, rows), Settings(shards=16)).collect()
    text, loads, slots = dict(rows), [0] * 16, {}
    for r in got:
        data = text[r.doc_id].encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 16
    assert max(loads) - min(loads) <= 0.005 * sum(loads) / 16
    where = {}
    assert all(where.setdefault(r.virtual_slot, r.shard) == r.shard for r in got)


def test_first_map_is_the_greedy_one(spark):
    s = Settings(shards=5, slots=64)
    sums = slot_bytes(records(docs_of(spark, [(i, words(i, i % 50)) for i in range(300)]), s), s)
    loads, want = [0] * 5, {}
    for n, slot in sorted(((-r.bytes, r.virtual_slot) for r in sums.collect())):
        at = loads.index(min(loads))
        loads[at] -= n
        want[slot] = at
    assert {r.virtual_slot: r.shard for r in first_map(sums, s).collect()} == want


def test_growth_moves_rows_into_the_new_shard_only(spark, tmp_path):
    s = Settings(shards=4, slots=256)
    sums = slot_bytes(records(docs_of(spark, [(i, words(i, i % 60)) for i in range(2000)]), s), s).cache()
    folder = str(tmp_path / "map")
    write_map(first_map(sums, s), folder)
    write_map(grown(read_map(spark, folder), sums, 4), folder)
    both = newest(read_map(spark, folder)).withColumnRenamed("shard", "after").join(first_map(sums, s).select("virtual_slot", "shard"), "virtual_slot")
    assert both.where("after <> shard and after <> 4").count() == 0
    loads = {r.after: r.b for r in both.join(sums, "virtual_slot").groupBy("after").agg(F.sum("bytes").alias("b")).collect()}
    assert len(loads) == 5 and max(loads.values()) - min(loads.values()) < 0.1 * sum(loads.values()) / 5


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = place(docs, Settings()).collect()
    assert len(got) == 13 and all(r.size == 1 and r.text_crc32 == 0 for r in got if r.doc_id in (3, 4))
    assert len({r.shard for r in got if r.doc_id == 2}) == 1
    assert place(docs.limit(0)).count() == 0
    out = sharded(docs)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["virtual_slot", "shard"] and out.count() == 13
    assert sharded(docs.limit(0)).count() == 0


def test_a_record_that_fills_a_third_of_the_table(spark):
    rows = [(i, words(i, 30)) for i in range(8000)] + [(77, "the same record again and again " * 4)] * 2500 + [(None, "nameless " * 9)] * 1500
    s = Settings(slots=512, cells=4)
    got = place(docs_of(spark, rows).repartition(5), s).collect()
    loads, slots, cells = [0] * 16, {}, {}
    for r in got:
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        cells[r.virtual_slot] = cells.get(r.virtual_slot, 0) + 1
    assert len(got) == 12_000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 16 and max(cells.values()) < 200
    assert len({r.virtual_slot for r in got if r.doc_id == 77}) > 300

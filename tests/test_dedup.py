import random

import pytest

from strandlog.operators.dedup import DeliveryIndex, duplicate_rows
from strandlog.runtime import Scratch

SCHEMA = "d long, b long, id string, at long, hash string, prefix string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    best = {}
    for d, _, i, at in rows:
        if i is not None:
            key = (at is None, at or 0, d)
            best[i] = min(best.get(i, key), key)
    return {d for d, _, i, at in rows if i is not None and best[i][2] != d}


def some(seed, n=300):
    rng = random.Random(seed)
    rows = [(d, d // 40, rng.choice([f"e{rng.randrange(90)}", "hot", "hot"]) if d % 50 else None, rng.choice([None, 1, 2, 3, rng.randrange(1000)])) for d in range(n)]
    rows.append((n, 3, "", 5))
    return rows


@pytest.mark.parametrize("rounds", [1, 3, 20])
def test_whole_log(spark, rounds):
    rows = some(rounds)
    got = [r[0] for r in duplicate_rows(frame(spark, rows), "id", "at", "d", "b", Scratch(spark, "t").path("i"), rounds, bucket_rows=16).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_batches_in_any_order_with_merged_runs(spark):
    rows = some(7)
    batches = [[r for r in rows if r[1] % 6 == k] for k in range(6)]
    random.Random(1).shuffle(batches)
    path = Scratch(spark, "t").path("i")
    lost = []
    for b in batches:
        index = DeliveryIndex(spark, path, max_runs=2, bucket_rows=1)  # opened again each time, as by a new process
        lost += [r[0] for r in index.apply(frame(spark, b), "id", "at", "d").collect()]
    assert len(index.runs) <= 2 and len({r.bits for r in index.runs} | {5}) > 1, "buckets follow the size"
    assert sorted(lost) == sorted(brute(rows))
    kept = {r.id: r.row for r in index.kept().collect()}
    assert set(kept.values()) == {d for d, _, i, _ in rows if i is not None} - brute(rows)


def test_failed_batch_leaves_the_index_as_it_was(spark, monkeypatch):
    path = Scratch(spark, "t").path("i")
    index = DeliveryIndex(spark, path)
    index.apply(frame(spark, [(1, 0, "a", 1)]), "id", "at", "d")
    monkeypatch.setattr(index, "_commit", lambda runs: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.apply(frame(spark, [(2, 1, "b", 1)]), "id", "at", "d")
    again = DeliveryIndex(spark, path)
    assert {r.id for r in again.kept().collect()} == {"a"}
    assert again.apply(frame(spark, [(2, 1, "b", 1), (3, 1, "a", 0)]), "id", "at", "d").collect()[0][0] == 1


def test_second_writer_is_refused(spark):
    path = Scratch(spark, "t").path("i")
    a, b = DeliveryIndex(spark, path), DeliveryIndex(spark, path)
    a.apply(frame(spark, [(1, 0, "a", 1)]), "id", "at", "d")
    with pytest.raises(RuntimeError):
        b.apply(frame(spark, [(2, 0, "a", 1)]), "id", "at", "d")


def test_empty(spark):
    assert duplicate_rows(frame(spark, []), "id", "at", "d", "b", Scratch(spark, "t").path("i")).count() == 0


def test_whole_log_merges_runs_on_the_way(spark, monkeypatch):
    merged = []
    compact = DeliveryIndex.compact
    monkeypatch.setattr(DeliveryIndex, "compact", lambda self: merged.append(len(self.runs)) or compact(self))
    rows, path = some(5), Scratch(spark, "t").path("i")
    got = [r[0] for r in duplicate_rows(frame(spark, rows), "id", "at", "d", "b", path, bucket_rows=8).collect()]
    assert merged == [3] and len(DeliveryIndex(spark, path).runs) == 2
    assert sorted(got) == sorted(brute(rows))


def test_merge_keeps_the_newest_and_tells_ids_of_one_hash_apart(spark, tmp_path):
    import pyarrow as pa

    from strandlog.operators import dedup

    root, runs = f"file://{tmp_path}", []
    for k, rows in enumerate([[(1, "a", 5), (1, "b", 6), (7, "c", 7)], [(1, "b", 1), (1, "a", 2)], [(7, "c", 0), (2**62, "d", 3)]]):
        t = pa.table({"hash": [r[0] for r in rows], "id": [r[1] for r in rows], "time": [r[2] for r in rows], "row": [r[2] for r in rows]})
        runs.append(dedup.Run(f"r{k}", 1, len(rows), {0: dedup._write_run(f"{root}/r{k}", 0, t)}))
    got = [(r["hash"], r["id"], r["row"]) for r in dedup._merged(root, runs, 0, 1).to_pylist()]
    assert sorted(got) == [(1, "a", 2), (1, "b", 1), (7, "c", 0), (2**62, "d", 3)] and [g[0] for g in got] == [1, 1, 7, 2**62]
    assert [r["id"] for r in dedup._merged(root, runs, 1, 2).to_pylist()] == ["d"], "a stretch of a larger bucket"

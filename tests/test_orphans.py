from datetime import datetime

import pytest

from conftest import rough
from corpusloom.operators.orphans import advance, bootstrap, compacted, orphans, snapshot
from corpusloom.plans import references as P

ENTRY, REF = "entry_id long, key string, added timestamp_ntz, removed timestamp_ntz", "tbl string, rec_id long, pos long, key string, at timestamp_ntz"


def day(n):
    return datetime(2024, 1, n) if n else None


def entries(spark, rows):
    return spark.createDataFrame([(i, k, day(a), day(r)) for i, k, a, r in rows], ENTRY)


def refs(spark, rows):
    return spark.createDataFrame([("t", i, 0, k, day(at)) for i, k, at in rows], REF)


def kinds(state):
    return {r["rec_id"]: r["kind"] for r in orphans(state).collect()}


def test_kinds(spark):
    e = entries(spark, [(1, "a", 5, 10), (2, "a", 5, 10), (3, "a", 8, 12), (4, "b", 5, 5), (5, "c", 20, None), (6, None, 1, None), (7, "d", None, None)])
    r = refs(spark, [(1, "a", 4), (2, "a", 5), (3, "a", 9), (4, "a", 11), (5, "a", 12), (6, "b", 6), (7, "c", 19), (8, "zzz", 9), (9, "d", 9), (10, None, 9), (11, "a", 0)])
    assert kinds(bootstrap(e, r)) == {1: "late", 5: "deleted", 6: "deleted", 7: "late", 8: "missing", 9: "missing"}


def test_arrivals_resolve_and_deletions_reopen(spark):
    s = bootstrap(entries(spark, [(1, "a", 1, None)]), refs(spark, [(1, "a", 9), (2, "b", 9)]))
    assert kinds(s) == {2: "missing"}
    s = advance(s, entries(spark, [(2, "b", 3, None)]), refs(spark, [(3, "c", 9)]))
    assert kinds(s) == {3: "missing"}
    s = advance(s, entries(spark, [(1, "a", 1, 5)]), refs(spark, []))
    assert kinds(s) == {1: "deleted", 3: "missing"}
    assert {(r["month"], r["kind"]): r["n"] for r in snapshot(s).collect()} == {("2024-01", "deleted"): 1, ("2024-01", "missing"): 1}


def test_batches_give_the_state_of_one_batch(spark, data):
    e, r = P.inventory_entries(spark, data), P.audio_references(spark, data)
    whole = {(x["tbl"], x["rec_id"], x["pos"]): x["kind"] for x in orphans(bootstrap(e, r)).collect()}
    cut = "timestamp_ntz'2024-07-01'"
    s = bootstrap(e.where("entry_id % 3 = 0"), r.where(f"at < {cut}"))
    s = advance(s, e.where("entry_id % 3 = 1"), r.where(f"at >= {cut}").limit(0))
    s = advance(s, e.where("entry_id % 3 = 2"), r.where(f"at >= {cut}"))
    assert {(x["tbl"], x["rec_id"], x["pos"]): x["kind"] for x in orphans(s).collect()} == whole


@pytest.mark.parametrize("rows", [0, None])
def test_rough_tables(spark, tmp_path, rows):
    d = rough(tmp_path, rows)
    assert (P.p4_found(spark, d).count() == 0) == (rows == 0)
    P.p4_counts(spark, d).collect()


def _rows_written(state, after):
    return sum(len(part.collect()) for name, parts in after.segments.items() for part in parts[len(state.segments[name]) :])


def test_a_batch_writes_no_more_than_it_brings(spark):
    """What a batch writes doesn't grow with the history: its own rows, its keys' index and the statuses that turn."""
    s = bootstrap(entries(spark, [(i, f"k{i}", 1, None) for i in range(400)]), refs(spark, [(i, f"k{i}", 9) for i in range(800)]))
    s2 = advance(s, entries(spark, [(500, "k500", 2, None), (3, "k3", 1, 5)]), refs(spark, [(900, "k500", 9), (901, "zz", 9)]))
    assert _rows_written(s, s2) == 2 + 2 + 1 + 1 + 2  # entries, index, settled, new orphan, resolved and reopened
    assert {k for k in kinds(s2) if k < 400} == {3} and 500 not in kinds(s2) and kinds(s2)[901] == "missing"
    assert all(len(a) == len(b) + 1 and a[: len(b)] == b for a, b in ((s2.segments[n], s.segments[n]) for n in s.segments))


def test_reopened_twice_and_compacted(spark):
    s = bootstrap(entries(spark, [(1, "a", 1, None)]), refs(spark, [(1, "a", 9), (2, "b", 9), (2, "b", 9)]))
    seen = []
    for e in ([(1, "a", 1, 5)], [(2, "a", 6, None)], [(2, "a", 6, 8), (3, "b", 9, None)], []):
        s = advance(s, entries(spark, e), refs(spark, []))
        seen.append(kinds(s))
    assert seen == [{1: "deleted", 2: "missing"}, {2: "missing"}, {1: "deleted"}, {1: "deleted"}]
    c = compacted(s)
    assert kinds(c) == kinds(s) and all(len(x) == 1 for x in c.segments.values())
    assert kinds(advance(c, entries(spark, [(4, "a", 8, None)]), refs(spark, [(7, "a", 9)]))) == {}


def test_hot_key(spark):
    """A third of the references and entries are of one key."""
    e = entries(spark, [(i, "hot" if i % 3 == 0 else f"k{i}", 1 + i % 20, None) for i in range(6000)])
    r = refs(spark, [(i, "hot" if i % 3 == 0 else f"k{i + i % 2}", 25) for i in range(6000)])
    s = bootstrap(e, r)
    assert "hot" in s.hot
    s = advance(s, entries(spark, [(i, "hot", 1 + i % 20, 22) for i in range(0, 6000, 3)]), refs(spark, []))
    assert {k for k in kinds(s) if k % 3 == 0} == set(range(0, 6000, 3)) and kinds(s)[0] == "deleted"

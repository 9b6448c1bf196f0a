import random
from datetime import datetime, timedelta

from bibspark.operators.snapshot_diff import snapshot_changes

P = "snapshot_id int, dblp_key string, record_type string, title string, year int, venue string, doi string, mdate string, loaded_at timestamp, key string"
M = "snapshot_id int, key string, value string, title string"
FIELDS = slice(2, 7)


def brute(pubs, meta, order):
    state = {}
    for r in pubs:
        if r[0] is None or r[1] is None:
            continue
        at = ("publications", r[1], r[0])
        row = ((r[8] is not None, r[8] or 0), *[(v is not None, v if v is not None else 0) for v in r[FIELDS]])
        state[at] = max(state.get(at, row), row)
    values = {k: tuple("" if not ok or v == "" else str(v) for ok, v in row[1:]) for k, row in state.items()}
    for s, k, v, _ in meta:
        if s is not None and k is not None:
            at = ("metadata", k, s)
            values[at] = max(values.get(at, ("",)), (v or "",))
    out = set()
    keys = {(e, k) for e, k, _ in values}
    for before, after in zip(order, order[1:]):
        for e, k in keys:
            a, b = values.get((e, k, before)), values.get((e, k, after))
            if a != b:
                out.add((e, k, after, "added" if a is None else "removed" if b is None else "changed"))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    t0 = datetime(2026, 1, 1)
    # By instant the order is 1, 3, 2: the later id was downloaded earlier.
    meta = [(1, "downloaded_at", "2026-01-01T00:00:00+00:00", ""), (2, "downloaded_at", "2026-03-01T00:40:00-03:00", ""), (3, "downloaded_at", "2026-03-01T01:30:00+02:00", "")]
    meta += [(s, k, rng.choice(["a", "b", "", None]), "x") for s in (1, 2, 3) for k in "uvw" if rng.random() < 0.7]
    meta += rng.choices(meta, k=4) + [(None, "u", "z", ""), (2, None, "z", "")]
    pubs = []
    for _ in range(300):
        pubs.append((
            rng.choice([1, 2, 3]), f"k{rng.randrange(40)}", rng.choice(["article", "book"]), rng.choice(["T", "", None]), rng.choice([2000, None]),
            rng.choice(["V", "", None]), rng.choice(["", None]), "m", t0 + timedelta(seconds=rng.randrange(1000)), "clash",
        ))
    pubs += pubs[:20] + [(None, "k1", "", "", 1, "", "", "", t0, ""), (1, None, "", "", 1, "", "", "", t0, "")]
    got = snapshot_changes(spark.createDataFrame(pubs, P), spark.createDataFrame(meta, M))
    assert {tuple(r)[:4] for r in got.collect()} == brute(pubs, meta, [1, 3, 2])
    assert got.count() == len({tuple(r)[:4] for r in got.collect()})


def test_fields_and_empty(spark):
    t = datetime(2026, 1, 1)
    pubs = [(1, "k", "a", "T", 1, None, "d", "", t, ""), (2, "k", "a", "U", 2, "", "d", "", t, "")]
    meta = [(1, "downloaded_at", "2026-01-01T00:00:00Z", ""), (2, "downloaded_at", "2026-02-01T00:00:00Z", "")]
    rows = snapshot_changes(spark.createDataFrame(pubs, P), spark.createDataFrame(meta, M)).collect()
    assert {(r["item_key"], r["change"], tuple(r["fields"])) for r in rows} == {("k", "changed", ("title", "year")), ("downloaded_at", "changed", ("value",))}
    assert snapshot_changes(spark.createDataFrame([], P), spark.createDataFrame([], M)).count() == 0
    # Without metadata the load times give the order.
    assert [r["snapshot_id"] for r in snapshot_changes(spark.createDataFrame(pubs, P), spark.createDataFrame([], M)).collect()] == [2]

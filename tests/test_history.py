import random
from datetime import datetime, timedelta

from evidex.operators import history as H

SCHEMA = "id string, subject_normalized string, predicate string, group_object_key string, object_text string, valid_from timestamp_ntz, valid_to timestamp_ntz, observed_at timestamp_ntz, recorded_at timestamp_ntz, status string, slice int, eff string"
T0 = datetime(2024, 1, 1)


def us(t):
    return int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def brute(data):
    keys = {}
    for r in data:
        e = r[5] or r[7]
        if e is not None:
            keys.setdefault(r[1:4], []).append((e, r[8], r[0], r[6], r[4], r[9]))
    out = set()
    for k, rows in keys.items():
        best = {x[0]: x for x in sorted(rows, key=lambda x: x[:3])}
        obj = st = None
        periods = []
        seq = [best[e] for e in sorted(best)]
        for n, (e, _, _, to, o, s) in enumerate(seq):
            obj, st = o if o is not None else obj, s if s is not None else st
            ends = [x for x in (seq[n + 1][0] if n + 1 < len(seq) else None, to) if x is not None]
            end = min(ends) if ends else None
            if st in H.DEAD or end is not None and end <= e:
                continue
            look = (st, None if obj is None else " ".join(obj.split()).lower())
            if periods and periods[-1][1] == e and periods[-1][2] == look:
                periods[-1][1] = end
            else:
                periods.append([e, end, look])
        out |= {(*k, us(a), -1 if b is None else us(b)) for a, b, _ in periods}
    return out


def test_versions_match_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    data = []
    for n in range(900):
        key = ("user", "drives", "") if rng.random() < 0.5 else (rng.choice(["a", "b", None]), rng.choice(["p", "q"]), rng.choice(["", None]))
        at = T0 + timedelta(hours=rng.randrange(400))
        start = rng.choice([at, None])
        data.append((f"{n:04}", *key, rng.choice(["X", " x ", "y", None]), start, rng.choice([None, None, at + timedelta(hours=rng.randrange(-2, 6))]), rng.choice([at, at, None]), at + timedelta(hours=rng.randrange(3)), rng.choice(["accepted", "candidate", None, "rejected", "superseded"])))
    df = spark.createDataFrame([(*r, 7, "clash") for r in data], SCHEMA)
    got = H.belief_versions(df, slices=7)
    assert {tuple(r) for r in got.select(*H.KEY, "valid_from_us", "valid_to_us").collect()} == brute(data)


def test_satellites_only_hold_changes(spark):
    rows = [("1", "s", "p", "", "x", T0, None, T0, T0, "accepted", 0, "")] + [(str(n), "s", "p", "", " X", T0 + timedelta(days=n), None, T0, T0, None, 0, "") for n in range(2, 6)]
    sats = H.satellites(H.filled(H.sliced(H.effective_states(spark.createDataFrame(rows, SCHEMA)), 3)))
    assert {k: v.count() for k, v in sats.items()} == {"slow": 1, "fast": 1, "ends": 1}


def test_empty(spark):
    assert H.belief_versions(spark.createDataFrame([], SCHEMA), slices=2).count() == 0

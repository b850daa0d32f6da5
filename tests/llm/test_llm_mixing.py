import math
import random
from fractions import Fraction

import duckdb
import pytest

from kinfold.llm import mixing

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "source as key", "source as h", "1 as slot", "2 as n", "3 as q")


def simulate(q, slots):
    """Earliest deadline first, a slot at a time; q by source in their order."""
    total, had, out = sum(q), [0] * len(q), []
    for slot in range(slots):
        ready = [(-(-(had[i] + 1) * total // q[i]), -q[i], i) for i in range(len(q)) if q[i] and had[i] * total // q[i] <= slot]
        i = min(ready)[2]
        had[i] += 1
        out.append(i)
    return out


def live_slots(got):
    """(slot, source) of the blocks before the first source ran out, without gaps."""
    live = sorted({(r.slot, r.source) for r in got if r.in_mix})
    assert [t for t, _ in live] == list(range(len(live)))
    return live


def deviation(live, shares):
    """The largest distance from the target at any slot, in blocks."""
    had, most = dict.fromkeys(shares, 0), Fraction(0)
    for t, s in live:
        had[s] += 1
        most = max(most, *(abs(n - shares[x] * (t + 1)) for x, n in had.items()))
    return most


@pytest.mark.parametrize("q", [[500, 300, 200], [97, 1, 1, 1], [333, 333, 334], [91, 909], [1], [3, 3, 3, 2, 2, 7]])
def test_schedule_is_that_of_the_definition(spark, q):
    sources = [f"k{i}" for i in range(len(q))]
    rows = [(i, s, "t") for i, s in enumerate(s for s, x in zip(sources, q) for _ in range(3 * x + 1))]
    got = mixing.mix(table(spark, rows), dict(zip(sources, q)), block_rows=1).collect()
    live = live_slots(got)
    assert len(live) >= 3 * sum(q) and [s for _, s in live] == [sources[i] for i in simulate(q, len(live))]
    assert all(r.slot_release <= r.slot < r.slot_due for r in got if r.in_mix)


@pytest.mark.parametrize("targets", [{"a": 0.97, "b": 0.01, "c": 0.01, "d": 0.01}, {"a": 0.9, **{f"s{i}": 0.1 / 97 for i in range(97)}}, {"a": math.pi, "b": 2**0.5, "c": 0.001}])
def test_less_than_one_block_from_the_target_over_many_periods(spark, targets):
    total = sum(targets.values())
    rows = [(i, s, "t") for i, s in enumerate(s for s, w in targets.items() for _ in range(int(12_000 * w / total) + 1))]
    got = mixing.mix(table(spark, rows), targets, block_rows=1).collect()
    live = live_slots(got)
    shares = {s: Fraction(w) / sum(map(Fraction, targets.values())) for s, w in targets.items()}
    assert len(live) > 8000 and deviation(live, shares) < 1 + Fraction(1, 10_000)


def test_hot_source_zero_target_and_unnamed_sources(spark):
    sizes = {"hot": 6000, **{f"s{i:02d}": 200 for i in range(19)}, None: 200}
    rows = [(i, s, "t") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    targets = {"hot": 0.3, "s00": 0.0, None: 0.1, "absent": 5.0, **{f"s{i:02d}": 0.03 for i in range(1, 10)}}
    got = mixing.mix(table(spark, rows), targets, other=0.02, block_rows=2).collect()
    assert len(got) == len(rows) and len({(r.slot, r.pos_in_block) for r in got}) == len(rows)
    weights = {s: Fraction(str(targets.get(s, 0.02))) for s in sizes}
    assert deviation(live_slots(got), {s: w / sum(weights.values()) for s, w in weights.items()}) < 1
    assert min(r.slot for r in got if r.source == "s00") > max(r.slot for r in got if r.source != "s00")
    for s in sizes:
        mine = [r.slot for r in sorted(got, key=lambda r: r.source_pos) if r.source == s]
        assert mine == sorted(mine)
    # past the first dry source the others keep their proportions
    rest = sorted((r.slot, r.source) for r in got if not r.in_mix and r.source in ("hot", "s10"))[:500]
    assert abs(sum(s == "hot" for _, s in rest) / len(rest) - 0.3 / 0.32) < 0.05


def test_many_sources(spark):
    r = random.Random(4)
    rows = [(i, f"s{i % 3000}", "t") for i in range(12_000)]
    targets = {f"s{i}": r.randint(1, 9) for i in range(2000)}
    got = mixing.mix(table(spark, rows), targets, other=3, block_rows=1).collect()
    assert len({r.slot for r in got}) == len(rows)
    weights = {f"s{i}": targets.get(f"s{i}", 3) for i in range(3000)}
    live = live_slots(got)
    assert len(live) > 1000
    had = dict.fromkeys(weights, 0)
    for t, s in live:
        had[s] += 1
        assert had[s] * sum(weights.values()) < weights[s] * (t + 1) + sum(weights.values())
    assert all(r.slot < r.slot_due for r in got if r.in_mix)


def test_tempered_weights_without_targets(spark):
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None, "t") for i in range(3000)]
    got = mixing.mix(table(spark, rows), block_rows=5).collect()
    assert len(got) == 3000 and len({(r.slot, r.pos_in_block) for r in got}) == 3000
    assert sorted(r.source_pos for r in got if r.source == "small") == list(range(1, 501))
    sizes = {"big": 2000, "small": 500, None: 500}
    raw = {s: n**mixing.TEMPER for s, n in sizes.items()}
    assert deviation(live_slots(got), {s: Fraction(w / sum(raw.values())) for s, w in raw.items()}) < 1 + Fraction(1, 100)


def test_mixed_rows_follow_the_schedule(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "t") for i in range(200)]
    df = table(spark, rows)
    place = {r.doc_id: (r.slot, r.pos_in_block) for r in mixing.mix(df, {"a": 3, "b": 1}).collect()}
    mixing.mixed(df, {"a": 3, "b": 1}).write.parquet(f"{tmp_path}/m")
    back = spark.read.parquet(f"{tmp_path}/m").selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index i").collect()
    assert [place[r.doc_id] for r in sorted(back, key=lambda r: (r.f, r.i))] == sorted(place.values())


def test_query_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r.asDict().values()) for r in mixing.mix(docs, mixing.TARGETS, other=mixing.OTHER).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert got == set(con.execute(mixing.ORACLE).fetchall())


def test_edges(spark):
    for targets in (None, {"a": 1}, {}):
        assert mixing.mix(table(spark, []), targets).collect() == []
    rows = [(1, None, None), (None, "a", ""), (1, None, None), (2, "a", "x" * 100_000)]
    for targets in (None, {"a": 1}, {}, {"a": 0}):
        got = mixing.mix(table(spark, rows), targets).collect()
        assert len(got) == 4 and sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
        assert len({(r.slot, r.pos_in_block) for r in got}) == 4
    with pytest.raises(ValueError):
        mixing.mix(table(spark, rows), {"a": -1})


def test_no_python_in_the_plan(spark):
    for targets in (None, {"a": 1}):
        plan = mixing.mix(table(spark, [(1, "a", "t")]), targets)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

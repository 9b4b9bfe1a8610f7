"""Spark against the row-by-row model, whole and split over blocks."""

import random
from collections import defaultdict

import pytest
from inputs import AS_OF, forecast, lot, make_sources, order
from model import ledger as model_ledger
from shelflife.operators.hot_refs import BLOCK
from shelflife.operators.hot_refs import over_parts
from shelflife.operators.ledger import lot_neighbors
from shelflife.params import CONSUMPTION_RULES, ReportParams
from shelflife.plans.reports import aggregated_lots, lot_parts, projected_lots

RESULTS = ("inv_after_custord", "consumption_factor", "inv_after_custord_and_fcst")


def random_inputs(seed, refs=60, most_lots=14):
    """Lots with ties, unknown days and dates out of step with days left;
    orders below, at and above the stock, also negative."""
    rng = random.Random(seed)
    lots, orders, rates = [], [], []
    for ref in range(refs):
        sku = f"s{ref}"
        for i in range(rng.randint(1, most_lots)):
            days = rng.choice([None, rng.randint(-5, 3), rng.randint(-5, 40), rng.randint(10, 90), 20])
            date_days = days if rng.random() < 0.7 else rng.choice([None, rng.randint(-5, 60)])
            lots.append(lot(sku, f"L{i:03d}", days, float(rng.randint(-4, 30)), order_days=date_days))
        for _ in range(rng.randint(0, 3)):
            orders.append(order(sku, float(rng.choice([-20, 0, 5, 30, 60, 400]))))
        if rng.random() < 0.8:
            rates += forecast(sku, float(rng.choice([0, 30, 60, 150])))
    return lots, orders, rates or forecast("none", 0.0)


def expected(lots, orders, rates, rule):
    """Model results keyed by (ref, lot number)."""
    groups, totals, rate = defaultdict(list), defaultdict(float), {}
    for row in lots:
        groups[f"{row[0]}_{row[1]}"].append(row)
    for location, sku, _, cases in orders:
        totals[f"{location}_{sku}"] += cases
    for location, sku, _, month, cases, _ in rates:
        if month >= "202209":
            rate[f"{location}_{sku}"] = rate.get(f"{location}_{sku}", 0.0) + cases
    out = {}
    for ref, rows in groups.items():
        last = float("inf")
        # Lot numbers are unique within a ref, so no later column matters.
        rows.sort(key=lambda r: (last if r[5] is None else r[5], last if r[7] is None else r[7], r[3]))
        daily = round(rate.get(ref, 0.0) / 145)
        results = model_ledger([(r[7], r[8]) for r in rows], totals[ref], float(daily), rule)
        out |= {(ref, r[3]): result for r, result in zip(rows, results)}
    return out


def run(spark, inputs, **changes):
    lots, orders, rates = inputs
    sources = make_sources(spark, inventory_lots=lots, customer_orders=orders, forecast=rates)
    params = ReportParams.base(AS_OF, **changes)
    parts = lot_parts(sources, params)
    done = over_parts(parts, lambda lots, layout: projected_lots(lots, sources, params, layout))
    rows = done.select("ref", "lot_number", *RESULTS).collect()
    return parts, {(r[0], r[1]): tuple(r[2:]) for r in rows}


@pytest.mark.parametrize("rule", CONSUMPTION_RULES)
@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_matches_model(spark, seed, rule):
    inputs = random_inputs(seed)
    _, got = run(spark, inputs, consumption_rule=rule)
    assert got == expected(*inputs, rule)


@pytest.mark.parametrize("lots_per_task", [1, 3, 10])
def test_split_refs_match_model(spark, lots_per_task):
    inputs = random_inputs(3, refs=8, most_lots=30)
    parts, got = run(spark, inputs, lots_per_task=lots_per_task)
    assert [part.layout.split for part in parts] == [False, True]
    assert got == expected(*inputs, "prev_shippable")


def test_long_shortage_carries_through(spark):
    """150 lots in one carry chain."""
    lots = [lot("a", f"L{i:03d}", 20 + i, 1.0) for i in range(150)]
    inputs = (lots, [], forecast("a", 145.0))
    want = expected(*inputs, "prev_shippable")
    assert min(v[2] for v in want.values()) < -500
    assert run(spark, inputs)[1] == want
    parts, got = run(spark, inputs, lots_per_task=20)
    assert parts[1].lots.select(BLOCK).distinct().count() > 4
    assert got == want


def test_one_hot_ref_is_spread_over_blocks(spark):
    """A third of all lots on one ref; every block stays near the target."""
    lots = [lot("hot", f"L{i:05d}", i % 300, 1.0 + i % 5) for i in range(3000)]
    lots += [lot(f"c{i % 1000}", f"L{i:05d}", i % 90, 2.0) for i in range(6000)]
    inputs = (lots, [order("hot", 500.0)], forecast("hot", 3000.0))
    parts, got = run(spark, inputs, lots_per_task=250)
    sizes = {r[0]: r[1] for r in parts[1].lots.groupBy(BLOCK).count().collect()}
    assert sum(sizes.values()) == 3000 and len(sizes) >= 10 and max(sizes.values()) < 1000
    assert got == expected(*inputs, "prev_shippable")


def test_small_blocks_share_tasks(spark):
    """A block is no larger than asked for, and there is no task for each."""
    inputs = random_inputs(4, refs=40, most_lots=30)
    parts, got = run(spark, inputs, lots_per_task=2)
    sizes = [r[1] for r in parts[1].lots.groupBy(BLOCK).count().collect()]
    assert len(sizes) > 50 and max(sizes) == 2
    assert parts[1].lots.rdd.getNumPartitions() < 10
    assert got == expected(*inputs, "prev_shippable")


def test_null_days_first_middle_last(spark):
    lots = []
    for where in range(3):
        for i in range(3):
            lots.append(lot(f"n{where}", f"L{i}", None if i == where else 20 + 5 * i, 10.0, order_days=20 + 5 * i))
    inputs = (lots, [order(f"n{w}", 4.0) for w in range(3)], forecast("n0", 145.0) + forecast("n1", 145.0))
    assert run(spark, inputs)[1] == expected(*inputs, "prev_shippable")


@pytest.mark.parametrize("lots_per_task", [2, 10**6])
def test_neighbors(spark, lots_per_task):
    lots = [lot("a", f"L{i}", 20 + i, float(i)) for i in range(9)] + [lot("b", "L0", 5, 7.0)]
    sources = make_sources(spark, inventory_lots=lots)
    params = ReportParams.base(AS_OF, lots_per_task=lots_per_task)
    near = over_parts(
        lot_parts(sources, params),
        lambda lots, layout: lot_neighbors(
            projected_lots(lots, sources, params, layout), {"sum_of_inventory_qty": "previous_qty"}, layout
        ),
    )
    got = {(r.ref, r.lot_seq): (r.previous_ref, r.next_ref, r.previous_qty) for r in near.collect()}
    assert got[("10_b", 1)] == (None, None, None)
    assert got[("10_a", 1)] == (None, "10_a", None)
    assert got[("10_a", 9)] == ("10_a", None, 7.0)
    assert [got[("10_a", i)][2] for i in range(2, 10)] == [float(i) for i in range(8)]


def test_copies_of_a_lot_are_summed(spark):
    lots = [lot("a", "L1", 20, 2.0)] * 30 + [lot("a", "L1", 21, 5.0)]
    supply = aggregated_lots(make_sources(spark, inventory_lots=lots), ReportParams.base(AS_OF))
    assert sorted(r.sum_of_inventory_qty_w_neg for r in supply.collect()) == [5.0, 60.0]

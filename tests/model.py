"""A row-by-row model of the ledger in plain Python: a walk with the balance of
stock against orders and the carry recursion, with unknown (None) conditions."""

from __future__ import annotations


def compare(a, b, test):
    return None if a is None or b is None else test(a, b)


def positive(a):
    return compare(a, 0, lambda x, y: x > y)


def not_positive(a):
    return compare(a, 0, lambda x, y: x <= y)


def both(*conditions):
    if any(c is False for c in conditions):
        return False
    return None if any(c is None for c in conditions) else True


def minus(a, b):
    return None if a is None or b is None else a - b


def choose(branches, otherwise=None):
    """First true branch; an unknown condition before it makes the result unknown."""
    for condition, value in branches:
        if condition is None:
            return None
        if condition:
            return value
    return otherwise


def ledger(lots, orders, rate, rule="prev_shippable", horizon=15):
    """`lots` is a list of (days_left, quantity) of one item-location in lot
    order. Returns (after orders, consumption, after forecast) per lot."""
    days = [d for d, _ in lots]
    qty = [max(q, 0.0) for _, q in lots]
    shippable = [None if d is None else (0.0 if d <= 0 else q) for d, q in zip(days, qty)]
    balance = -orders
    results, before = [], None
    for i, (d, q) in enumerate(zip(days, qty)):
        first = i == 0
        prev_days = None if first else days[i - 1]
        # Orders that earlier shippable lots left open come off this one.
        if orders == 0 or not_positive(d):
            after = q
        elif d is None or balance is None or (prev_days is None and not first):
            after = None
        else:
            covered = not first and prev_days > 0 and balance > 0
            after = q if covered else balance + q
        balance = minus(balance, None if shippable[i] is None else -shippable[i])
        ending = None if after is None else max(after, 0.0)
        follows = both(not first, positive(prev_days))
        diff = choose([(follows, minus(d, prev_days)), (None if follows is None else not follows, 0)])
        shares = {
            "prev_shippable": follows,
            "same_ref": not first,
            "self_shippable": both(not first, positive(d)),
        }[rule]
        if d is None:
            consumed = None
        elif d <= horizon:
            consumed = 0.0
        elif diff is None:
            consumed = None
        elif diff != 0:
            consumed = diff * rate
        else:
            consumed = None if shares is None else (0.0 if shares else (d - horizon) * rate)
        if d is None:
            value = None
        elif d <= 0:
            value = q
        elif not first and d <= horizon:
            value = ending
        elif first:
            value = minus(ending, consumed)
        else:
            net = minus(ending, consumed)
            value = None if net is None or before is None else net + min(before, 0.0)
        results.append((after, consumed, value))
        before = value
    return results

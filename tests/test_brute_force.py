"""Rewritten plans against plain Python on random facts with a hot customer."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from star_rows import NOW, event
from tollbook.operators import customers, offers

CATALOGUE = [
    (1, "Pass Data"), (2, "10 min"), (3, "Loan_Cash"), (4, "Plain"), (5, "Night Data"),
    (6, "Voice Max"), (7, "Loan_Other"), (8, "Plain Two"), (9, "Pass Data"),
]
NAMES = dict(CATALOGUE)


def random_events(seed):
    dice = random.Random(seed)
    events = []
    for number in range(600):
        events.append(
            event(
                number,
                0 if dice.random() < 0.35 else dice.randrange(1, 60),
                NOW - timedelta(minutes=dice.randrange(60 * 24 * 150)),
                offer_id=dice.choice([None, 99, *NAMES]),
                deduct_amount=None if dice.random() < 0.1 else dice.randrange(1000),
            )
        )
    return events


def segment(name):
    lowered = name.lower()
    for label, parts in (
        ("Data Users", ("data", "internet", "mo")),
        ("Voice-centric users", ("voice", "min", "sms")),
        ("Loan Users", ("loan",)),
    ):
        if any(part in lowered for part in parts):
            return label
    return "Mixed Users"


ALLOWED = {
    "Data Users": ("data", "internet"),
    "Voice-centric users": ("voice", "min", "sms"),
    "Loan Users": ("loan",),
    "Mixed Users": ("",),
}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_next_offer_counts_every_tied_main_offer(star, seed):
    events = [e for e in random_events(seed)]
    known = [e for e in events if e["offer_id"] in NAMES]
    uses = defaultdict(Counter)
    for e in known:
        uses[e["cust_num"]][NAMES[e["offer_id"]]] += 1
    earned = defaultdict(lambda: [set(), 0, 0, False])
    for cust, counter in uses.items():
        most = max(counter.values())
        for main in (name for name, n in counter.items() if n == most):
            for e in known:
                name = NAMES[e["offer_id"]]
                group = segment(main)
                if e["cust_num"] != cust or name == main:
                    continue
                if not any(part in name.lower() for part in ALLOWED[group]):
                    continue
                entry = earned[group, name]
                entry[0].add(cust)
                if e["deduct_amount"] is not None:
                    entry[1] += e["deduct_amount"]
                    entry[2] += 1
    expected = {}
    for group in {g for g, _ in earned}:
        best = sorted(
            ((name, v) for (g, name), v in earned.items() if g == group),
            key=lambda item: (-float(item[1][1]), item[0]),
        )
        for place, (name, v) in enumerate(best[:3], 1):
            expected[group, place] = (name, len(v[0]), float(v[1]), float(v[1]) / v[2])
    got = {
        (r["user_segment"], r["recommendation_rank"]): (
            r["recommended_offer"], r["users_count"], r["total_revenue"], r["avg_revenue_per_use"],
        )
        for r in offers.next_offer(star(events, offers=CATALOGUE)).collect()
    }
    assert got == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_offer_lifetime_without_looking_back(star, seed):
    events = random_events(seed)
    first = {}
    for e in events:
        key = e["cust_num"], e["offer_id"]
        first[key] = min(first.get(key, e["creation_time"]), e["creation_time"])
    days = defaultdict(list)
    for e in events:
        began = first[e["cust_num"], e["offer_id"]]
        days[e["offer_id"]].append((e["creation_time"].date() - began.date()).days)
    got = {
        r["offer_id"]: r["avg_offer_lifetime_days"]
        for r in offers.offer_performance(star(events, offers=CATALOGUE)).collect()
    }
    assert got == {o: sum(days[o]) / len(days[o]) if days[o] else 0.0 for o in NAMES}


def test_sequence_of_a_hot_customer(star):
    events = random_events(5)
    start = datetime(2023, 9, 30, 12, 0)
    known = [e for e in events if e["offer_id"] in NAMES and e["creation_time"] >= start]
    expected = set()
    per_customer = defaultdict(list)
    for e in known:
        per_customer[e["cust_num"]].append(e)
    for cust, own in per_customer.items():
        own.sort(key=lambda e: (e["creation_time"], e["cdr_event_id"]))
        for place, e in enumerate(own, 1):
            age = (e["creation_time"].date() - own[0]["creation_time"].date()).days
            expected.add((cust, e["creation_time"], place, age))
    got = {
        (
            r["cust_num"], r["creation_time"], r["transaction_sequence"],
            r["days_from_first_transaction"],
        )
        for r in customers.journey_sequence(star(events, offers=CATALOGUE), NOW).collect()
    }
    assert got == expected

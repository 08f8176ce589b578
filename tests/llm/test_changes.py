import math
import random
import zlib
from datetime import datetime, timedelta

import pytest

from quillsieve.llm import changes


def brute(rows):
    """The contract, step by step."""
    rows = list(dict.fromkeys(rows))
    ranks = {}
    for _, client, seq, *_ in rows:
        ranks.setdefault(client, set()).add(seq)
    order = {c: {s: k for k, s in enumerate(sorted(v, key=lambda x: (x is not None, x)), 1)} for c, v in ranks.items()}
    fed = {}
    for change, client, seq, op, at, city, balance in rows:
        h = zlib.crc32(str(change).encode())
        if at is None or h % 11 == 0:
            continue
        day = (at - datetime(1970, 1, 1)).days + 9 * (h % 4)
        batch = min(12, 1 + (day - 19723) * 12 // 160)
        fed.setdefault(batch, []).append((day, change, client, order[client][seq], op, city, balance))
    state, out, seen = {}, [], None

    def drain(client, batch, missed=0):
        s = state[client]
        while s["next"] in s["held"]:
            day, change, op, city, balance = s["held"].pop(s["next"])
            if op == "D":
                s["city"] = s["balance"] = None
            else:
                if op == "I" or city is not None:
                    s["city"] = city
                if op == "I" or balance is not None:
                    s["balance"] = balance
            out.append([change, client, "applied", batch, missed, s["city"], None if s["balance"] is None else math.floor(100 * s["balance"] + 0.5), False, op])
            s["last"], s["next"], missed = out[-1], s["next"] + 1, 0

    def jump(batch, limit):
        for client, s in state.items():
            while s["held"] and (limit is None or min(v[0] for v in s["held"].values()) + 3 <= limit):
                n = min(s["held"])
                missed, s["next"] = n - s["next"], n
                drain(client, batch, missed)

    for batch in sorted({*range(1, 13), *fed}):
        if seen is not None:
            jump(batch, seen)
        for day, change, client, n, op, city, balance in sorted(fed.get(batch, []), key=lambda r: (r[0], r[1])):
            s = state.setdefault(client, {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            if n in s["held"] or n < s["next"]:
                out.append([change, client, "rejected", batch, 0, None, None, False, op])
                continue
            s["held"][n] = (day, change, op, city, balance)
            drain(client, batch)
        if fed.get(batch):
            seen = max(seen or 0, max(r[0] for r in fed[batch]))
    jump(13, None)
    for s in state.values():
        if s["last"] is not None and s["last"][8] != "D":
            s["last"][7] = True
    return sorted((tuple(r[:8]) for r in out), key=repr)


SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double"


def found(frame):
    return sorted((tuple(r[c] for c in ("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")) for r in changes.applied(frame).collect()), key=repr)


def made(rng, n, clients):
    rows, seqs = [], {}
    start = datetime(2024, 1, 1)
    for k in range(n):
        client = rng.choice(clients) if rng.random() < 0.6 else clients[0]
        seqs[client] = seqs.get(client, 0) + rng.choice([0, 1, 1, 1, 2])
        at = start + timedelta(days=120 * k / n, hours=rng.randint(0, 30))
        seq = max(0, seqs[client] + rng.choice([0, 0, 0, -1, 2]))
        rows.append((k, client, seq, rng.choice("UUUID"), None if rng.random() < 0.02 else at, rng.choice(["A", "B" * 5000, None]) if k % 50 == 0 else rng.choice(["C", "D", None]), rng.choice([None, round(rng.uniform(-50, 50), 3)])))
    return rows + rng.sample(rows, n // 20)


@pytest.mark.parametrize("seed,clients", [(1, [5, 6, 7, None]), (2, [1])])
def test_against_brute_force(spark, seed, clients, monkeypatch):
    rng = random.Random(seed)
    rows = made(rng, 500, clients)
    if seed == 1:
        # No rows between: batches 5 to 8 are empty. One row a year early.
        rows = [r for r in rows if r[4] is None or not 40 <= (r[4] - datetime(2024, 1, 1)).days < 85]
        rows += [(9001, 8, None, "I", datetime(2023, 1, 1), "Z", 1.0), (9002, 8, 4, None, datetime(2024, 3, 30), None, 2.0)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_nothing_to_apply(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_dense_rank_of_a_hot_client(spark):
    rows = [(1 if k % 3 else 2, (k * 7919) % 1000) for k in range(5000)] + [(None, 3), (None, None), (1, None)]
    got = {(r["client_id"], r["seq"]): r["n"] for r in changes.ranked(spark.createDataFrame(rows, "client_id long, seq long")).collect()}
    for client in (1, 2, None):
        own = sorted({s for c, s in rows if c == client}, key=lambda s: (s is not None, s))
        assert [got[client, s] for s in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("seed,clients", [(3, [5, 6, 7, None]), (4, [None, 1])])
def test_clients_that_are_slices_of_their_own(spark, seed, clients, monkeypatch):
    """Clients with many numbers, those without client_id among them, beside slices of several clients."""
    monkeypatch.setattr(changes, "SLICE", 40)
    rows = made(random.Random(seed), 500, [*clients, *range(20, 50)])
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_keys_hold_many_clients(spark):
    """A call and a read of state for each client and number would cost a millisecond each."""
    rows = [(k, k % 3000, k, "U", datetime(2024, 1, 1) + timedelta(days=k % 100), "C", 1.0) for k in range(9000)]
    rows += [(10_000 + k, 7, 10_000 + k, "U", datetime(2024, 1, 1), "C", 1.0) for k in range(5000)]
    fed = changes.prepared(spark.createDataFrame(rows, SCHEMA)).cache()
    keys = {tuple(r) for r in fed.select("slice", "owner").distinct().collect()}
    assert (-1, 7) in keys and len(keys) <= 5 and fed.select("piece").distinct().count() <= 4
    assert fed.where("client_id = 7").select("piece").distinct().count() > 1

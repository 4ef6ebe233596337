"""Order-book streams for tests: literal cases and random ones."""

import random

from flowboard import schemas

COLUMNS = [f.split()[0] for f in schemas.ORDER_EVENT.split(", ")]


def row(sub, pos, type_, order_id, **kw):
    base = dict.fromkeys(COLUMNS)
    base.update(run_id="r", submission_id=sub, pos=pos, type=type_, order_id=order_id, **kw)
    return base


class Stream:
    def __init__(self, sub):
        self.sub, self.rows = sub, []

    def add(self, type_, oid, **kw):
        self.rows.append(row(self.sub, len(self.rows) * 3 + 1, type_, oid, **kw))

    def submit(self, oid, side, price, qty, kind="limit"):
        self.add("order_submitted", oid, side=side, kind=kind, price=float(price), quantity=qty)

    def ack(self, oid, accepted=True):
        self.add("order_ack", oid, accepted=accepted)

    def rest(self, oid, side, price, qty):
        self.submit(oid, side, price, qty)
        self.ack(oid)

    def fill(self, oid, maker, price, qty, left):
        self.add("order_filled", oid, maker_order_id=maker, fill_price=float(price), fill_quantity=qty,
                 remaining_quantity=left)

    def cancel(self, oid):
        self.add("order_cancelled", oid)


def random_stream(sub, seed, n=400, irregular=False):
    """Irregular streams also reuse ids, trade with themselves and submit without quantity."""
    rng, s, ids = random.Random(seed), Stream(sub), []
    for _ in range(n):
        u = rng.random()
        if u < 0.5 or len(ids) < 3:
            fresh = not irregular or not ids or rng.random() < 0.7
            oid = len(ids) + 1 if fresh else rng.choice(ids[-8:])
            if fresh:
                ids.append(oid)
            qty = 0 if irregular and rng.random() < 0.05 else rng.randint(1, 8)
            s.submit(oid, rng.choice(["buy", "sell"]), round(100 + rng.randint(-4, 4) * 0.01, 2), qty,
                     "limit" if rng.random() < 0.8 else "market")
            if rng.random() < 0.9:
                s.ack(oid, rng.random() < 0.95)
            if irregular and rng.random() < 0.2:
                s.ack(oid)
        elif u < 0.9:
            taker, maker = rng.choice(ids[-6:]), rng.choice(ids[-10:])
            if maker == taker and not irregular:
                continue
            if rng.random() < 0.05:
                maker = 10_000 + maker
            qty = 0 if irregular and rng.random() < 0.05 else rng.randint(1, 8)
            s.fill(taker, maker, round(100 + rng.randint(-4, 4) * 0.01, 2), qty, rng.randint(0, 4))
        else:
            s.cancel(rng.choice(ids[-12:]))
    return s.rows


def literal_cases():
    out = {}
    s = Stream("clean"); s.rest(1, "buy", 100, 10); s.submit(2, "sell", 0, 10, "market"); s.ack(2)
    s.fill(2, 1, 100, 10, 0); out["clean"] = (s.rows, {})
    s = Stream("price"); s.rest(1, "buy", 100, 10); s.rest(2, "buy", 101, 10); s.submit(3, "sell", 0, 5, "market")
    s.fill(3, 1, 100, 5, 0); out["price"] = (s.rows, {"price_time_priority": 1})
    s = Stream("fifo"); s.rest(1, "buy", 100, 10); s.rest(2, "buy", 100, 10); s.submit(3, "sell", 0, 5, "market")
    s.fill(3, 2, 100, 5, 0); out["fifo"] = (s.rows, {"fifo": 1})
    s = Stream("over"); s.rest(1, "buy", 100, 10); s.submit(2, "sell", 0, 25, "market")
    s.fill(2, 1, 100, 25, 0); out["over"] = (s.rows, {"fill_quantity": 1})
    s = Stream("print"); s.rest(1, "buy", 100, 10); s.submit(2, "sell", 0, 5, "market")
    s.fill(2, 1, 99, 5, 0); out["print"] = (s.rows, {"trade_matching": 1})
    s = Stream("phantom"); s.submit(2, "sell", 0, 5, "market"); s.fill(2, 999, 100, 5, 0)
    out["phantom"] = (s.rows, {"book_consistency": 1})
    return out

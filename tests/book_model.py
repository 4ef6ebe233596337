"""What the rules say about an order stream, worked out by definition: every state is derived anew from
the list of events before a position. Slow, for tests only."""

from functools import cached_property

TICK = 0.01
BOOK, TRADE, PRICE, FIFO, QUANTITY = "book_consistency", "trade_matching", "price_time_priority", "fifo", "fill_quantity"


class Model:
    def __init__(self, rows):
        self.rows = sorted(rows, key=lambda e: e["pos"])
        self.named = {}
        for e in self.rows:
            for oid in {e["order_id"], e["maker_order_id"]} - {None}:
                self.named.setdefault(oid, []).append(e)
        self.memo = {}

    def intent(self, oid, pos):
        """Last submit before `pos`: (side, kind, price, quantity, pos)."""
        for e in reversed(self.named.get(oid, [])):
            if e["type"] == "order_submitted" and e["pos"] < pos:
                return ("sell" if e["side"] == "sell" else "buy", e["kind"], e["price"], e["quantity"], e["pos"])

    def resting(self, oid, pos):
        """(side, price, left, since) of an order that rests just before `pos`, else None."""
        if (oid, pos) not in self.memo:
            now = None
            for e in self.named.get(oid, []):
                if e["pos"] >= pos:
                    break
                now = self.after(oid, e, now)
            self.memo[oid, pos] = now
        return self.memo[oid, pos]

    def after(self, oid, e, now):
        if e["type"] == "order_ack" and e["accepted"] and now is None:
            said = self.intent(oid, e["pos"])
            return (said[0], said[2], said[3], e["pos"]) if said and said[1] == "limit" else None
        if e["type"] == "order_cancelled":
            return None
        if e["type"] != "order_filled" or now is None:
            return now
        taken = 0
        if e["maker_order_id"] == oid:
            taken += e["fill_quantity"]
        if e["order_id"] == oid and self.resting(e["maker_order_id"], e["pos"]):
            taken += e["fill_quantity"]
        side, price, left, since = now
        if left == 0:  # an order without quantity rests until it is cancelled
            return now
        return (side, price, left - taken, since) if left > taken else None

    def open_quantity(self, oid, pos):
        """What a taker may still trade, None where unknown or forgotten by a cancel."""
        said = self.intent(oid, pos)
        if said is None:
            return None
        left = said[3]
        for e in self.named[oid]:
            if said[4] < e["pos"] < pos:
                if e["type"] == "order_cancelled" and self.resting(oid, e["pos"]):
                    return None
                if e["type"] == "order_filled" and e["order_id"] == oid:
                    left = max(0, left - e["fill_quantity"])
        return left

    def book(self, pos):
        return {oid: r for oid in self.named if (r := self.resting(oid, pos))}

    @staticmethod
    def tick(price):
        return int(price / TICK + 0.5)

    def judge(self, e):
        """(rule, message, order_id, pos) of what one event breaks, in order."""
        pos, oid = e["pos"], e["order_id"]
        say = lambda rule, text: (rule, text, oid, pos)
        if e["type"] == "order_ack" and e["accepted"]:
            said = self.intent(oid, pos)
            if said and said[1] == "limit" and self.resting(oid, pos):
                return [say(BOOK, "engine accepted the same order_id twice")]
        if e["type"] == "order_cancelled" and not self.resting(oid, pos):
            return [say(BOOK, "cancel for an order not resting in the book")]
        if e["type"] != "order_filled":
            return []
        mid, price, qty, out = e["maker_order_id"], e["fill_price"], e["fill_quantity"], []
        maker = self.resting(mid, pos)
        if maker is None:
            return [say(BOOK, f"fill names maker {mid} that is not resting in the book")]
        side, at, left, since = maker
        said, taker_left = self.intent(oid, pos), self.open_quantity(oid, pos)
        if said and said[0] == side:
            out.append(say(TRADE, f"aggressor and maker {mid} are both {side}"))
        if abs(price - at) > TICK / 2:
            out.append(say(TRADE, f"fill price {price:.4f} != resting maker price {at:.4f}"))
        if said and said[1] == "limit":
            if said[0] == "buy" and price > said[2] + TICK / 2:
                out.append(say(TRADE, f"buy filled at {price:.4f} above its limit {said[2]:.4f}"))
            if said[0] == "sell" and price < said[2] - TICK / 2:
                out.append(say(TRADE, f"sell filled at {price:.4f} below its limit {said[2]:.4f}"))
        # An order without quantity rests at no price level.
        same_side = {i: r for i, r in self.book(pos).items() if r[0] == side and r[2] > 0}
        ticks = [self.tick(r[1]) for r in same_side.values()]
        best, mine = max(ticks, key=lambda t: t if side == "buy" else -t, default=None), self.tick(at)
        if best not in (None, mine):
            out.append(say(PRICE, f"filled maker at tick {mine} while a better price (tick {best}) was resting"))
        front = min(((r[3], i) for i, r in same_side.items() if self.tick(r[1]) == mine), default=(0, mid))[1]
        if front != mid:
            out.append(say(FIFO, f"filled maker {mid} ahead of earlier order {front} at the same price"))
        if qty <= 0:
            out.append(say(QUANTITY, "fill quantity must be positive"))
        elif qty > left:
            out.append(say(QUANTITY, f"fill qty {qty} exceeds maker remaining {left}"))
        if taker_left is not None:
            if qty > taker_left:
                out.append(say(QUANTITY, f"fill qty {qty} exceeds aggressor remaining {taker_left}"))
            elif e["remaining_quantity"] != taker_left - qty:
                out.append(say(QUANTITY, f"reported remaining {e['remaining_quantity']} != expected {taker_left - qty}"))
        if taker_left is None or taker_left <= qty:
            after = self.book(pos + 1).values()
            bids, asks = ([self.tick(r[1]) for r in after if r[0] == s and r[2] > 0] for s in ("buy", "sell"))
            if bids and asks and max(bids) >= min(asks):
                out.append(say(BOOK, "book left crossed after aggressor fully traded"))
        return out

    @cached_property
    def findings(self):
        return [f for e in self.rows for f in self.judge(e)]

    @property
    def orders(self):
        return sum(e["type"] == "order_filled" for e in self.rows)

    @property
    def trades(self):
        return sum(e["type"] == "order_filled" and self.resting(e["maker_order_id"], e["pos"]) is not None for e in self.rows)

    @property
    def by_rule(self):
        out = {}
        for rule, *_ in self.findings:
            out[rule] = out.get(rule, 0) + 1
        return out

    @property
    def score(self):
        return max(0.0, min(1.0, 1 - len(self.findings) / max(self.orders, 1)))

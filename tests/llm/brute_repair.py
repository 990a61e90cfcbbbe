"""Damage and repair of conversations in plain Python, by trying every cheapest string of edits."""

import hashlib
import zlib
from collections import defaultdict
from heapq import heappop, heappush

BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if lot == 0:
            continue
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(lot, text)
        role = "user" if lot == 4 else role
        own += [(turn, role, text)] * (2 if lot == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    return out


def repair(rows):
    """cost, audit, repaired lines: Dijkstra by (cost, audit) over (rows read, roles' initials so far as a state)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    seen, faults = set(), []
    for _, role, text in rows:
        stripped = text.rstrip(BLANKS)
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, k, state, lines = heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return faults, cost, audit, lines
        if (k, state) in done:
            continue
        done.add((k, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in after:
                heappush(heap, (cost + 3, audit + "I", k, role[0], (*lines, f"{role}:")))
        if k < len(rows):
            _, role, text = rows[k]
            heappush(heap, (cost + 4, audit + "D", k + 1, state, lines))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 if faults[k] == "truncated" else 0
                if (state, role[:1]) in after:
                    heappush(heap, (cost + more, audit + "K", k + 1, role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in after:
                        heappush(heap, (cost + 3 + more, audit + "R", k + 1, new[0], (*lines, f"{new}:{text}")))


def digests(rows):
    out = []
    for conv, own in damage(rows).items():
        faults, cost, audit, lines = repair(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out

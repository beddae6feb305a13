"""Plain versions of the spelling, id file and conversation operators."""

import functools
import hashlib
import re
import zlib
from collections import Counter

UPPER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    letters = set(a) | set(b)
    edits = {a[:k] + a[k + 1 :] for k in range(len(a))}
    edits |= {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in letters}
    edits |= {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in letters}
    return a != b and b in edits


def variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def damaged(rows):
    """{conv_id: rows (role, text)} after the damage, and the turns."""
    out, turns = {}, {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []), turns.setdefault(conv, set())
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [((turn is not None, turn or 0), role, text)] * (2 if kind == 3 else 1)
        turns[conv].add(turn)
    return {c: [r[1:] for r in sorted(v)] for c, v in out.items()}, turns


def faults(rows):
    found, seen = [], set()
    for role, text in rows:
        visible = text.rstrip(" \t\n\v\f\r")
        if not visible.strip(" \t\n\v\f\r"):
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def repaired(rows):
    """(cost, audit, lines) by trying every edit of every row with all costs kept."""
    kinds = faults(rows)
    wanted = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))

        def add(cost, letter, line, rest):
            if rest:
                options.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if inserted < 2:
            add(5, "I", (wanted[state] + ":",), best(i, after[state], inserted + 1))
        if i < len(rows):
            role, text = rows[i]
            add(2, "D", (), best(i + 1, state, 0))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 5 if kinds[i] == "truncated" else 0
                if (state, role[:1]) in keep:
                    add(extra, "K", (f"{role}:{text}",), best(i + 1, keep[state, role[:1]], 0))
                add(1 + extra, "R", (f"{wanted[state]}:{text}",), best(i + 1, after[state], 0))
        return min(options, key=lambda o: o[:2], default=None)

    for i in range(len(rows), -1, -1):  # from the end, so that the recursion stays shallow
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def reports(rows):
    out, turns = damaged(rows)
    found = {}
    for conv, held in out.items():
        kinds = faults(held)
        cost, audit, lines = repaired(tuple(held))
        known = turns[conv] - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        initials = [r[:1] for r, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, text)
    return found

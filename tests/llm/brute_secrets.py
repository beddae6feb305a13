"""Credential spans by a plain loop over one text."""

import re

SCOPE = 400
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = ["assign", "access", "hex", "key", "user", "endpoint"]


def base(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def all_spans(text):
    found = base(text)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) >= 20 and all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")):
            found.append(("key", m.start(), m.end()))
    for m in re.finditer(r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+""", text):
        found.append(("user", m.start(), m.end()))
    for m in re.finditer(r"(?:(?<![A-Za-z0-9+])[a-z][a-z0-9+]*://[A-Za-z0-9_.:@-]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+\.[A-Za-z0-9-][A-Za-z0-9.-]*:[0-9]+)", text):
        found.append(("endpoint", m.start(), m.end()))
    kept = []
    for kind, start, end in found:
        def near(kinds):
            return any(
                k in kinds and s <= end + SCOPE and e >= start - SCOPE and (s >= end or e <= start) for k, s, e in found
            )

        wanted = {
            "key": [["access", "user", "endpoint"]], "user": [["assign", "hex", "key"]],
            "endpoint": [["access", "user"], ["assign", "hex", "key"]],
        }.get(kind, [])
        if all(near(k) for k in wanted):
            kept.append((kind, start, end))
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))

"""Bytes covered by earlier strings, by a dictionary of all strings."""

LENGTH = 100


def removed(texts):
    """``texts``: (doc_id, text) pairs; {doc_id: (n_removed, n_spans, kept)}."""
    seen, out = set(), {}
    for doc, text in sorted(texts):
        body = text.encode()
        gone = bytearray(len(body))
        for i in range(len(body) - LENGTH + 1):
            string = body[i : i + LENGTH]
            if string in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(string)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out[doc] = (sum(gone), spans, bytes(b for b, g in zip(body, gone) if not g))
    return out

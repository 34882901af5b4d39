"""Small tables and brute-force versions for the text operators."""

import re

CLASH = "digest string, kept int, n long, entity string, ids string, score string, lines string, id long, root string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows: (doc_id, text); the other columns have names that operators use inside, some null."""
    data = [(i, t, "en" if k % 2 else None, None, "x", 1, None, "e", None, "s", "l", 5, None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, n_chars long, {CLASH}")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(rows):
    """doc_id → smallest doc_id reachable over links of similarity 0.75 or more."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_pii(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]

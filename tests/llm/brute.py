"""Plain versions of what the operators compute, for small tables."""

import re
import zlib
from collections import Counter
from math import log10

SPACE = " \t\n\x0b\x0c\r"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def fold(doc_id, parts):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def groups(n, pairs):
    """Smallest member of the group of each of n items."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def fingerprint(text):
    from xxhash import xxh64_intdigest

    ws = words(ascii_lower(text))
    if not ws:
        return 0
    hashes = [xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def redact(text):
    """Base spans replaced; overlapping ones by the first."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans(text)):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, -end)
    return None if text is None else "".join(out) + text[at:]


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Rounds of resharing the excess; sizes by source, None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {s: 0.0 for s in order}, set(order)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] > limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                open_.discard(s)
    return target


def quality_counts(text):
    ws = words(text)
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i:i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def base_scores(docs):
    """doc_id -> (held_out, n_tokens, n_known, train tokens, base score)."""
    tokens = {d: [*words(ascii_lower(t)), "\n"] for d, t in docs}
    c = Counter(w for d, ws in tokens.items() if fold(d, 5) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return {
        d: (fold(d, 5) == 1, len(ws), sum(c[w] > 0 for w in ws), n,
            sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for d, ws in tokens.items()
    }

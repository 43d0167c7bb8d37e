"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([int(c) for c in s if c.isdigit()])):
        total += c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c)
    return total % 10 == 0


def personal(text: str | None) -> tuple:
    text = text or ""
    n_digits = lambda s: sum(c in "0123456789" for c in s)
    kinds = {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= n_digits(m[0]) <= 19 and luhn(m[0])],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= n_digits(m[0]) <= 15],
    }
    said = ",".join(f"{k}:{a}:{b}" for k, v in kinds.items() for a, b in v)
    return (*[len(v) for v in kinds.values()], hashlib.sha256(said.encode()).hexdigest())


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contaminated(docs: list[tuple], items: list[tuple], size: int = 13) -> dict:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(UPPER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[t]
        ids = ",".join(sorted(map(str, found)))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def without_repeats(docs: list[tuple], size: int = 50) -> dict:
    words = {d: SPACED.findall(t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out

"""The masks in plain Python, row after row: what the jobs must reproduce."""

from __future__ import annotations

import hashlib

from veilwork.functions import providers as p


def seed(salt: str, identifier: str, attempt: int = 0) -> str:
    return hashlib.md5(f"{salt}:{identifier}:{attempt}".encode()).hexdigest()


def draw(seed_hex: str, k: int) -> int:
    return int(hashlib.sha256(seed_hex.encode()).hexdigest()[6 * k:6 * k + 6], 16)


def phone(seed_hex: str) -> str:
    return f"+1-555-{draw(seed_hex, 0) % 10000:04d}"


def first_name(seed_hex: str, locale: str = "en_US") -> str:
    return p.FIRST_NAMES[locale][draw(seed_hex, 0) % 6]


def full_name(seed_hex: str) -> str:
    return p.FIRST_NAMES["en_US"][draw(seed_hex, 0) % 6] + " " + p.LAST_NAMES["en_US"][draw(seed_hex, 1) % 6]


def greedy(rows, value, tries, taken=()):
    """``rows``: keys in order; ``value(key, attempt)``; returns key -> try, None when exhausted."""
    seen, out = set(taken), {}
    for key in rows:
        out[key] = None
        for attempt in range(tries):
            v = value(key, attempt)
            if v not in seen:
                seen.add(v)
                out[key] = attempt
                break
    return out


def greedy_joint(rows, values, tries, taken=()):
    """Like :func:`greedy` for several columns: ``values(key, attempt)`` is a tuple, None is nobody's value."""
    seen, out = set(taken), {}
    for key in rows:
        out[key] = None
        for attempt in range(tries):
            offered = {(i, v) for i, v in enumerate(values(key, attempt)) if v is not None}
            if not offered & seen:
                seen |= offered
                out[key] = attempt
                break
    return out

"""Pieces of the SQL that states the expected results of the registered queries."""

from __future__ import annotations

from ..functions import providers as p
from ._common import SALT


def pk_seed(table: str, pk: str, salt: str = SALT, attempt: str = "0") -> str:
    return f"md5(concat('{salt}:{table}:', {pk}, ':', {attempt}))"


def value_seed(column: str, salt: str = SALT, attempt: str = "0") -> str:
    return f"md5(concat('{salt}:', coalesce({column}::VARCHAR, '<nil>'), ':', {attempt}))"


def pick(k: int, n: int, h: str = "h") -> str:
    return f"(('0x' || substr({h}, {6 * k + 1}, 6))::BIGINT % {n})"


def choose(k: int, values: list[str], h: str = "h") -> str:
    listed = ", ".join("'" + v + "'" for v in values)
    return f"([{listed}])[{pick(k, len(values), h)} + 1]"


def counter(seed: str = "seed") -> str:
    u = f"('0x' || substr({seed}, 1, 16))::UBIGINT::HUGEINT"
    return f"(CASE WHEN {u} <= 9223372036854775808 THEN CASE WHEN {u} = 9223372036854775808 THEN -{u} ELSE {u} END " \
           f"ELSE 18446744073709551616 - {u} END)::BIGINT"


def provider(name: str, h: str = "h", locale: str = "en_US") -> str:
    first, last = p.FIRST_NAMES[locale], p.LAST_NAMES[locale]
    if name == "first_name":
        return choose(0, first, h)
    if name == "last_name":
        return choose(0, last, h)
    if name == "full_name":
        return f"({choose(0, first, h)} || ' ' || {choose(1, last, h)})"
    if name == "email":
        a, b = choose(0, first, h), choose(1, last, h)
        domains = ", ".join(f"'{d}'" for d in p.EMAIL_DOMAINS)
        return f"({a} || '.' || {b} || '@' || ([{domains}])[(strlen({a}) + strlen({b})) % 3 + 1])"
    if name == "company_name":
        return choose(0, p.COMPANIES, h)
    if name == "phone_number":
        return f"printf('+1-555-%04d', {pick(0, 10000, h)})"
    if name == "ipv4_address":
        return "concat_ws('.', " + ", ".join(pick(k, 256, h) for k in range(4)) + ")"
    if name == "short_text":
        return "(" + " || ".join(f"substr('{p.TEXT_ALPHABET}', {pick(k, 62, h)} + 1, 1)" for k in range(10)) + ")"
    if name == "username":
        return f"(lower({choose(0, first, h)}) || '_' || printf('%04d', {pick(1, 10000, h)}))"
    return "'" + p.TEST_VALUES[name] + "'"


def masked(table: str, pk: str, columns: dict[str, str], salt: str = SALT, where: str = "",
           seeds: dict[str, str] | None = None, base: str = "") -> str:
    """``base`` (default: the table) with columns replaced.

    Expressions may use ``seed`` and ``h`` of the key, and ``h_<name>`` /
    ``seed_<name>`` for each entry of ``seeds``.
    """
    extra = "".join(f", {sql} AS seed_{name}" for name, sql in (seeds or {}).items())
    hashes = "".join(f", sha256(seed_{name}) AS h_{name}" for name in (seeds or {}))
    helper = ["seed", "h", *[f"seed_{n}" for n in (seeds or {})], *[f"h_{n}" for n in (seeds or {})]]
    changed = ", ".join(
        f"{sql} AS {c}" if not where else f"CASE WHEN {where} THEN {sql} ELSE {c} END AS {c}"
        for c, sql in columns.items())
    return (f"WITH s AS (SELECT *, {pk_seed(table, pk, salt)} AS seed{extra} FROM {base or table}), "
            f"d AS (SELECT *, sha256(seed) AS h{hashes} FROM s) "
            f"SELECT * EXCLUDE ({', '.join(helper)}) REPLACE ({changed}) FROM d")


def serial(table: str, pk: str, candidate: str, tries: int, taken: str = "", where: str = "true",
           salt: str = SALT, by_value: str = "") -> str:
    """CTEs walking the rows in key order; ``tries_of(pk, attempt)`` has the first free try, or NULL.

    ``candidate`` is the value as an expression over the digest ``h``.
    """
    attempt = "i.a"
    seed = value_seed(by_value, salt, attempt) if by_value else pk_seed(table, pk, salt, attempt)
    return f"""WITH RECURSIVE options AS MATERIALIZED (
  SELECT {pk} AS pk, list({candidate} ORDER BY a) AS vals FROM (
    SELECT t.*, i.a, sha256({seed}) AS h FROM {table} t, range({tries}) AS i(a) WHERE {where}) GROUP BY 1),
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pk) AS rn, pk, vals FROM options),
walk AS (
  SELECT 0::BIGINT AS rn, {taken or "[]::VARCHAR[]"} AS seen, NULL::BIGINT AS attempt
  UNION ALL
  SELECT rn, CASE WHEN free IS NULL THEN seen ELSE list_append(seen, vals[free + 1]) END, free FROM (
    SELECT n.rn, w.seen, n.vals,
      list_filter(range({tries}), lambda j: NOT list_contains(w.seen, n.vals[j + 1]))[1] AS free
    FROM walk w JOIN numbered n ON n.rn = w.rn + 1)),
tries_of AS (SELECT n.pk, n.vals, w.attempt FROM numbered n JOIN walk w USING (rn))"""

"""Fake-data providers: expressions over the draws of a row.

A provider is ``fn(scope) -> Column``.  ``domain`` is the number of different
values it can give (an upper bound that must hold), used to tell early that no
free value is left; ``None`` means practically unbounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seed import SeedScope

DEFAULT_LOCALE = "en_US"

# Fixed values ---------------------------------------------------------------
FIRST_NAMES = {
    "en_US": ["John", "Jane", "Alice", "Bob", "Charlie", "Diana"],
    "de_DE": ["Hans", "Jürgen", "Karl", "Stefan", "Monika", "Angelika"],
    "fr_FR": ["Jean", "Marie", "Pierre", "Camille", "Luc", "Élodie"],
    "es_ES": ["Juan", "María", "Carlos", "Lucía", "José", "Carmen"],
}
LAST_NAMES = {
    "en_US": ["Doe", "Smith", "Johnson", "Williams", "Brown", "Jones"],
    "de_DE": ["Müller", "Schmidt", "Schneider", "Fischer", "Weber", "Meyer"],
    "fr_FR": ["Martin", "Bernard", "Dubois", "Durand", "Moreau", "Lefèvre"],
    "es_ES": ["García", "Fernández", "González", "Rodríguez", "López", "Martínez"],
}
COMPANIES = ["Acme Corp", "Globex", "Soylent Corp", "Initech", "Umbrella Corp"]
EMAIL_DOMAINS = ["example.com", "test.org", "mail.com"]
TEXT_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
TEXT_LENGTH = 10
TEST_VALUES = {
    "test_name": "Test User",
    "test_email": "test@example.com",
    "test_username": "test_user_1",
    "test_company": "Test Corp",
    "test_phone": "+1-555-0000",
    "test_ipv4": "127.0.0.1",
    "test_short_text": "test_text",
}
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Provider:
    build: Callable[[SeedScope], Column]
    domain: int | None = None


class UnknownProvider(ValueError):
    pass


_registry: dict[tuple[str, str], Provider] = {}


def register_provider(name: str, build: Callable[[SeedScope], Column], locale: str = DEFAULT_LOCALE,
                      domain: int | None = None) -> None:
    """Add or replace a provider.

    ``build`` gets the row's :class:`SeedScope` and returns a string column.  A
    Python function can be used through an Arrow ``pandas_udf`` over
    ``scope.seed`` when no expression does the job.
    """
    _registry[locale, name] = Provider(build, domain)


def find_provider(name: str, locale: str | None = None) -> Provider:
    """The provider of the locale, else the one of the default locale."""
    for key in ((locale or DEFAULT_LOCALE, name), (DEFAULT_LOCALE, name)):
        if key in _registry:
            return _registry[key]
    raise UnknownProvider(f"unknown faker provider {name!r}")


def _full_name(locale: str) -> Callable[[SeedScope], Column]:
    return lambda s: F.concat_ws(" ", s.choose(0, FIRST_NAMES[locale]), s.choose(1, LAST_NAMES[locale]))


def _email(s: SeedScope) -> Column:
    # The mail domain follows from the name, by its length in bytes.
    first, last = FIRST_NAMES[DEFAULT_LOCALE], LAST_NAMES[DEFAULT_LOCALE]
    people = [f"{f}.{n}@{EMAIL_DOMAINS[len((f + n).encode()) % len(EMAIL_DOMAINS)]}" for f in first for n in last]
    at = s.pick(0, len(first)) * F.lit(len(last)) + s.pick(1, len(last))
    return F.get(F.array(*[F.lit(p) for p in people]), at)


def _phone(s: SeedScope) -> Column:
    return F.concat(F.lit("+1-555-"), F.lpad(s.pick(0, 10_000).cast("string"), 4, "0"))


def _ipv4(s: SeedScope) -> Column:
    return F.concat_ws(".", *[s.pick(k, 256).cast("string") for k in range(4)])


def _short_text(s: SeedScope) -> Column:
    return F.concat(*[s.choose(k, list(TEXT_ALPHABET)) for k in range(TEXT_LENGTH)])


def _username(s: SeedScope) -> Column:
    first = [n.lower() for n in FIRST_NAMES[DEFAULT_LOCALE]]
    return F.concat(s.choose(0, first), F.lit("_"), F.lpad(s.pick(1, 10_000).cast("string"), 4, "0"))


def _register_builtin() -> None:
    for locale in FIRST_NAMES:
        first, last = FIRST_NAMES[locale], LAST_NAMES[locale]
        register_provider("first_name", lambda s, v=first: s.choose(0, v), locale, len(first))
        register_provider("last_name", lambda s, v=last: s.choose(0, v), locale, len(last))
        register_provider("full_name", _full_name(locale), locale, len(first) * len(last))
    register_provider("email", _email, domain=36)
    register_provider("company_name", lambda s: s.choose(0, COMPANIES), domain=len(COMPANIES))
    register_provider("phone_number", _phone, domain=10_000)
    register_provider("ipv4_address", _ipv4, domain=256 ** 4)
    register_provider("short_text", _short_text, domain=len(TEXT_ALPHABET) ** TEXT_LENGTH)
    register_provider("username", _username, domain=60_000)
    for name, value in TEST_VALUES.items():
        register_provider(name, lambda _s, v=value: F.lit(v), domain=1)


_register_builtin()

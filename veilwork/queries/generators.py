"""Generators and providers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.generators import GenContext, register_generator
from ..functions.providers import TEST_VALUES, register_provider
from ..functions.seed import SeedScope
from . import _sql as sql
from ._common import faker, lookup, masked, rule, spec_of
from ..operators.mask import MaskedTable

CITIES = ["Springfield", "Riverton", "Lakeside", "Hillview"]
TEMPLATE = 'USER-{{ counter }}-{{ faker "first_name" }}-{{ hash }}'
FIELDS = ("{{ .TableName }}/{{ .ColumnName }}/{{ .PrimaryKeyValue }}/{{ .OriginalValue }}/"
          "{{ .Locale }}/{{ .Attempt }}")
BRANCHES = ('{{ if and (eq .OriginalValue "BUILDING" "HOUSEHOLD") (gt .PrimaryKeyValue 100) -}}\n'
            '  B{{ printf "%06d|%s" .PrimaryKeyValue .OriginalValue }}\n'
            '{{- else if or (lt (len .OriginalValue) 10) (not (ne .OriginalValue "AUTOMOBILE")) -}}\n'
            '  S-{{ faker "last_name" }}\n'
            '{{- else }}{{/* everything else */}}{{ printf "%s!" hash }}{{ end }}')


def _customer(columns: list[dict], **settings: object):
    return lambda spark, sf_dir: masked(spark, sf_dir, "customer", "c_custkey", columns, **settings).output()


def _provider(name: str, locale: str = ""):
    return _customer([faker("c_name", name)], locale=locale)


def _orders(columns: list[dict]):
    return lambda spark, sf_dir: masked(spark, sf_dir, "orders", "o_orderkey", columns).output()


def _hash_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Value seeds ignore the key, so a table without a unique key will do.
    return masked(spark, sf_dir, "lineitem", "l_orderkey", [
        {"name": "l_returnflag", "gen": {"type": "hash"}, "seed_by": "value"}]).output()


def _test_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = lookup(spark, sf_dir)
    base = find("customer").select("c_custkey", *[F.col("c_name").alias(n) for n in TEST_VALUES])
    spec = spec_of("customer", "c_custkey", [faker(n, n) for n in TEST_VALUES])
    return MaskedTable(base, spec.tables[0], spec).output()


def _coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masked(spark, sf_dir, "customer", "c_custkey",
                 [faker("c_name", "full_name"), faker("c_mktsegment", "email")]).output()
    agrees = F.substring_index("c_mktsegment", "@", 1) == F.replace("c_name", F.lit(" "), F.lit("."))
    return out.select("c_custkey", F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("email"),
                      agrees.alias("agrees"))


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir, "conversations", ["conv_id", "turn"], [
        faker("text", "short_text"), {"name": "role", "gen": {"type": "hash"}, "seed_by": "value"}]).output()


def _timestamp_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir, "events", ["ts", "event_id"], [
        rule("event_type", "hash"), faker("props", "short_text", seed_by="value")]).output()


def _initials(ctx: GenContext):
    return F.concat(F.substring(ctx.original, 1, 1), F.lit("-"), F.substring(ctx.seed, 1, 8))


def _city(scope: SeedScope):
    return F.concat_ws(" ", scope.choose(2, CITIES), scope.pick(3, 100).cast("string"))


def _extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_provider("example_city", _city, domain=400)
    return masked(spark, sf_dir, "customer", "c_custkey", [
        faker("c_name", "example_city"), rule("c_mktsegment", "example_initials")]).output()


register_generator("example_initials", _initials)

QUERIES = {
    "mask_customer_full": _customer([
        faker("c_name", "full_name"), rule("c_mktsegment", "template", template='{{ faker "email" }}')]),
    "gen_constant": _customer([rule("c_mktsegment", "constant", value="REDACTED"),
                               rule("c_nationkey", "constant", value="7")]),
    "gen_null": _orders([rule("o_orderpriority", "null")]),
    "gen_hash": _customer([rule("c_name", "hash")]),
    "gen_hash_by_value": _hash_by_value,
    "gen_counter": _orders([rule("o_custkey", "counter")]),
    "gen_template": _customer([rule("c_name", "template", template=TEMPLATE)]),
    "gen_template_fields": _customer([rule("c_mktsegment", "template", template=FIELDS)], locale="de_DE"),
    "gen_template_if": _customer([rule("c_mktsegment", "template", template=BRANCHES)]),
    "gen_faker_locale_fallback": _customer(
        [faker("c_name", "company_name"), faker("c_mktsegment", "first_name", locale="xx_XX")], locale="de_DE"),
    "fk_first_name": _provider("first_name"),
    "fk_first_name_de": _provider("first_name", "de_DE"),
    "fk_first_name_fr": _provider("first_name", "fr_FR"),
    "fk_last_name": _provider("last_name"),
    "fk_last_name_de": _provider("last_name", "de_DE"),
    "fk_full_name": _provider("full_name"),
    "fk_full_name_de": _provider("full_name", "de_DE"),
    "fk_full_name_es": _customer([faker("c_name", "full_name", locale="es_ES")]),
    "fk_email": _provider("email"),
    "fk_company": _provider("company_name"),
    "fk_phone": _provider("phone_number"),
    "fk_ipv4": _provider("ipv4_address"),
    "fk_short_text": _provider("short_text"),
    "fk_username": _provider("username"),
    "fk_test_providers": _test_providers,
    "fk_row_coherence": _coherence,
    "seed_composite_key": _composite,
    "seed_timestamp_key": _timestamp_key,
    "ext_custom_provider": _extension,
}


def _c(columns: dict[str, str], **kw: object) -> str:
    return sql.masked("customer", "c_custkey", columns, **kw)


def _p(name: str, locale: str = "en_US") -> str:
    return _c({"c_name": sql.provider(name, locale=locale)})


_ts_key = "concat(ts::VARCHAR, ' +0000 UTC:', event_id)"

ORACLES = {
    "mask_customer_full": _c({"c_name": sql.provider("full_name"), "c_mktsegment": sql.provider("email")}),
    "gen_constant": _c({"c_mktsegment": "'REDACTED'", "c_nationkey": "7::INTEGER"}),
    "gen_null": sql.masked("orders", "o_orderkey", {"o_orderpriority": "NULL::VARCHAR"}),
    "gen_hash": _c({"c_name": "seed"}),
    "gen_hash_by_value": sql.masked("lineitem", "l_orderkey", {"l_returnflag": "seed_v"},
                                    seeds={"v": sql.value_seed("l_returnflag")}),
    "gen_counter": sql.masked("orders", "o_orderkey", {"o_custkey": sql.counter()}),
    "gen_template": _c({"c_name": f"concat('USER-', {sql.counter()}, '-', {sql.provider('first_name')}, '-', seed)"}),
    "gen_template_fields": _c({
        "c_mktsegment": "concat('customer/c_mktsegment/', c_custkey, '/', c_mktsegment, '/de_DE/0')"}),
    "gen_template_if": _c({"c_mktsegment": f"""CASE
        WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_custkey > 100
          THEN concat('B', printf('%06d', c_custkey), '|', c_mktsegment)
        WHEN length(c_mktsegment) < 10 OR c_mktsegment = 'AUTOMOBILE' THEN concat('S-', {sql.provider('last_name')})
        ELSE concat(seed, '!') END"""}),
    "gen_faker_locale_fallback": _c({"c_name": sql.provider("company_name"),
                                     "c_mktsegment": sql.provider("first_name")}),
    "fk_first_name": _p("first_name"),
    "fk_first_name_de": _p("first_name", "de_DE"),
    "fk_first_name_fr": _p("first_name", "fr_FR"),
    "fk_last_name": _p("last_name"),
    "fk_last_name_de": _p("last_name", "de_DE"),
    "fk_full_name": _p("full_name"),
    "fk_full_name_de": _p("full_name", "de_DE"),
    "fk_full_name_es": _p("full_name", "es_ES"),
    "fk_email": _p("email"),
    "fk_company": _p("company_name"),
    "fk_phone": _p("phone_number"),
    "fk_ipv4": _p("ipv4_address"),
    "fk_short_text": _p("short_text"),
    "fk_username": _p("username"),
    "fk_test_providers": "SELECT c_custkey, " + ", ".join(f"'{v}' AS {n}" for n, v in TEST_VALUES.items())
                         + " FROM customer",
    "fk_row_coherence": f"SELECT c_custkey, c_name AS full_name, c_mktsegment AS email, true AS agrees FROM ("
                        f"{_c({'c_name': sql.provider('full_name'), 'c_mktsegment': sql.provider('email')})})",
    "seed_composite_key": sql.masked(
        "conversations", "concat(conv_id, ':', turn)", {"text": sql.provider("short_text"), "role": "seed_v"},
        seeds={"v": sql.value_seed("role")}),
    "seed_timestamp_key": sql.masked(
        "events", _ts_key, {"event_type": "seed", "props": sql.provider("short_text", "h_v")},
        seeds={"v": sql.value_seed("props")}),
    "ext_custom_provider": _c({
        "c_name": f"concat({sql.choose(2, CITIES)}, ' ', {sql.pick(3, 100)})",
        "c_mktsegment": "concat(substr(c_mktsegment, 1, 1), '-', substr(seed, 1, 8))"}),
}

"""Compare a Spark result with the SQL that states it, run by DuckDB."""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pyarrow as pa

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(table: pa.Table) -> list[tuple]:
    table = table.select(sorted(table.column_names))
    columns = [c.to_pylist() for c in table.columns]
    return sorted((tuple(repr(v) for v in row) for row in zip(*columns)))


def _types(table: pa.Table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def problems(spark_result, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    got, want = spark_result.toArrow(), con.execute(sql).to_arrow_table()
    found = []
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    a, b = _types(got), _types(want)
    found += [f"type of {c}: {a[c]} != {b[c]}" for c in a
              if a[c] != b[c] and not (a[c].startswith("timestamp") and b[c].startswith("timestamp"))
              and not a[c].startswith("list")]
    if got.num_rows != want.num_rows:
        found.append(f"rows {got.num_rows} != {want.num_rows}")
    x, y = _rows(got), _rows(want)
    if x != y:
        only_x, only_y = sorted(set(x) - set(y))[:3], sorted(set(y) - set(x))[:3]
        found.append(f"values differ: {str(only_x)[:900]}\n   !=   {str(only_y)[:900]}")
    return found


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, oracles = e.queries(), e.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            found = problems(queries[name](spark, sf_dir), con, oracles[name])
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {name} {time.time() - start:.1f}s", *found, flush=True)
    print(f"{bad} of {len(names or queries)} differ")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))

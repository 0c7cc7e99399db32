"""Program facts projected from the star-schema test tables, in SQL that Spark and DuckDB both run.

A part is a function, a supplier a class and a dispatch index, line items are statements. All is
plain integer arithmetic over distinct rows, as (l_orderkey, l_linenumber) is no key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: Node numbers of the dispatch graph: classes are suppliers.
NATION, REGION, INDEX, METHOD = 1_000_000, 2_000_000, 3_000_000_000, 4_000_000_000

_n = "(SELECT count(*) FROM part)"
_k = "(SELECT count(*) FROM supplier)"

FACTS = {
    "func": "SELECT p_partkey AS f, p_name AS name, p_type AS ret, concat(p_type, '/', CAST(p_size % 5 AS STRING)) AS full_type,"
    " p_size % 3 AS nargs, p_brand AS module, p_size AS size, p_size % 10 = 0 AS is_library, p_size % 7 = 0 AS is_stub FROM part",
    "entry": "SELECT p_partkey AS f FROM part WHERE p_size = 1",
    "call": f"SELECT DISTINCT l_partkey AS src, (l_suppkey * 13 + l_linenumber * 7) % {_n} AS dst FROM lineitem WHERE l_quantity = 1",
    "alloc": "SELECT DISTINCT l_partkey AS f, l_suppkey AS c FROM lineitem WHERE l_linestatus = 'F' AND l_quantity = 50",
    "dispatch": f"SELECT s_suppkey AS i, (s_suppkey * 13 + k * 37) % {_n} AS m, (s_suppkey * 3 + k) % {_k} AS c"
    " FROM supplier CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks",
    "ddg_edge": f"SELECT i + {INDEX} AS src, m + {METHOD} AS dst FROM dispatch UNION SELECT m + {METHOD}, c FROM dispatch"
    f" UNION SELECT s_suppkey, s_nationkey + {NATION} FROM supplier UNION SELECT n_nationkey + {NATION}, n_regionkey + {REGION} FROM nation",
    # 0, 1: a named function; 2, 3, 4: dispatch on a class; 5: a function value of unknown origin
    "site": f"SELECT DISTINCT (l_partkey * ({_k} + 1) + l_suppkey) * 8 + l_linenumber AS s, l_partkey AS f, l_suppkey AS i,"
    f" (l_suppkey * 13 + l_linenumber * 7) % {_n} AS target, l_suppkey % 6 AS kind, l_linenumber % 3 AS nargs,"
    " l_linenumber % 4 AS block FROM lineitem WHERE l_quantity <= 4",
    # four values of each function: 0 and 1 are parameters, 2 a local, 3 the result
    "vedge": f"SELECT DISTINCT l_partkey * 4 + l_linenumber % 4 AS src, ((l_suppkey * 17 + l_linenumber * 5) % {_n}) * 4 + l_suppkey % 4 AS dst"
    " FROM lineitem WHERE l_quantity IN (2, 3)",
    "vseed": f"SELECT f * 4 AS node, c AS what, 'class' AS kind FROM alloc UNION SELECT p_partkey * 4 + 1, (p_partkey * 7 + 3) % {_n}, 'func' FROM part WHERE p_size % 4 = 0",
    # flow inside functions, between callers and callees, over the four values of each
    "fedge": "SELECT DISTINCT l_partkey AS f, l_linenumber % 3 AS a, (l_linenumber + l_suppkey) % 4 AS b FROM lineitem WHERE l_quantity BETWEEN 5 AND 9",
    "fcall": f"SELECT DISTINCT l_partkey * 8 + l_linenumber AS s, l_partkey AS f, min((l_suppkey * 13 + l_linenumber * 7) % {_n}) AS g FROM lineitem"
    " WHERE l_quantity BETWEEN 10 AND 14 GROUP BY 1, 2",
    "farg": "SELECT s, f, s % 4 AS a, g, s % 2 AS q, 2 AS r FROM fcall",
    # field operations inside functions: 0 copy, 1 load, 2 store
    "ffield": "SELECT DISTINCT l_partkey AS f, l_linenumber % 4 AS a, (l_linenumber + l_suppkey) % 4 AS b, l_suppkey % 3 AS op,"
    " CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS field FROM lineitem WHERE l_quantity BETWEEN 15 AND 19",
    "fspec": "SELECT 'rule' AS name, CASE WHEN p_size < 6 THEN 'source' WHEN p_size < 12 THEN 'sink' ELSE 'sanitizer' END AS role, p_partkey AS f FROM part WHERE p_size < 15",
    "trace": "SELECT user_id AS obj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS event FROM events",
}


def with_facts(*names: str) -> str:
    """The facts and those they are made of, as common table expressions."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in FACTS:
            if other != name and f" {other} " in f" {FACTS[name]} ".replace(")", " ").replace("(", " ") and other not in needed:
                need(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        need(name)
    return ", ".join(f"{name} AS ({FACTS[name]})" for name in needed)


def facts(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named facts of the tables in sf_dir."""
    text = " ".join(with_facts(n) for n in names)
    for table in TABLES:
        if re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return {name: spark.sql(f"WITH {with_facts(name)} SELECT * FROM {name}") for name in names}

"""The queries that SQL can express, against DuckDB; registration of all."""

import random
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == sorted((tuple(map(plain, r)) for r in result.fetchall()), key=str)


def test_line_rules_match_sql(spark, tmp_path):
    rng = random.Random(9)
    short = ["Latest Stories", "World", "", " ", "Our Sports News", "About Contact Home", "Faq", "Ends here.", "no entry", "Two Three Four Five", "Élan", "9 News"]
    words = ["plain", "Word", "home", "CONTACT", "news", "ends.", "|", "x", "loud!!", "a#", "privacy", "policy", "(so)"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(22)))
    texts = ["\n".join(rng.choice(short) if rng.random() < p else line() for _ in range(rng.randrange(4, 30))) for p in (0.5, 0.9, 0.95) for _ in range(150)]
    spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "", "\n"])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = duck.execute(queries.ORACLE_SQL["op9_quality"])
    columns = [c[0] for c in result.description]
    want = sorted(map(tuple, result.fetchall()))
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES["op9_quality"](spark, str(tmp_path)).collect()) == want
    kept = [r[columns.index("kept")] for r in want if not r[columns.index("base_failed")]]
    assert any(kept) and not all(kept)


def test_all_are_registered():
    names = entry.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, len(queries.QUERIES) + 1)) and set(queries.QUERIES) | {"pipeline"} <= set(names)

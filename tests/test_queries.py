"""Every query beside the SQL that DuckDB runs on the same tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from deltashelf import queries as q

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def show(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return ""
        return format(x, ".9g") if isinstance(x, float) else str(x)

    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    got = q.queries()[name](spark, SMALL).toPandas()
    if name not in q.oracle_sql():
        assert len(got)
        return
    want = duck.sql(q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_flagship_plan_has_no_python(spark):
    plan = q.queries()["snapshot_price_diff"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_entry_without_the_optional_parts():
    """With corpus_pipeline.py and the llm folder out of reach everything else is still there."""
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("deltashelf.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert "snapshot_price_diff" in names and set(e.oracle_sql()) <= names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


@pytest.mark.parametrize("gone", [["deltashelf/llm"], ["deltashelf/llm", "corpus_pipeline.py"]])
def test_entry_in_a_copy_without_the_optional_parts(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(folder, n), root) in gone])
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n == set(e.oracle_sql()) and 'pipeline' not in n and len(n) > 100, len(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_captured_bodies_stay_small(spark, tmp_path, monkeypatch):
    """Over 40,000 rows every captured body holds the items of at most a thousand keys, and no row is lost."""
    from pyspark.sql import functions as F

    from deltashelf.plans import catalogue
    from deltashelf.sources import captured

    n = 40_000
    for name, key, more in (("part", "p_partkey", {"p_brand": "'B'", "p_size": "20", "p_name": "'n'", "p_retailprice": "1.0D"}), ("supplier", "s_suppkey", {"s_nationkey": "1L", "s_name": "'s'", "s_acctbal": "1.0D"})):
        spark.range(1, n + 1).select(F.col("id").alias(key), *(F.expr(v).alias(k) for k, v in more.items())).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.sql("select 1L n_nationkey, 'N' n_name, 2L n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    longest = {}

    def watch(name):
        f = getattr(captured, name)

        def watched(rows, *a, **k):
            longest[name] = rows.agg(F.max(F.length("body"))).first()[0]
            return f(rows, *a, **k)

        monkeypatch.setattr(captured, name, watched)

    for name in ("walk_sitemaps", "list_pages", "catalogue_tree", "vendor_catalogue"):
        watch(name)
    got = {name: getattr(catalogue, name)(spark, str(tmp_path)).count() for name in ("sitemap_urls", "bulk_store_products", "catalog_tree_flatten", "vendor_catalogue")}
    assert got == {"sitemap_urls": n, "bulk_store_products": n * 2 // 5, "catalog_tree_flatten": n * 9 // 10, "vendor_catalogue": n * 9 // 10}
    assert len(longest) == 4 and max(longest.values()) < 150_000, longest


def test_stripped_text_is_that_of_its_sql(spark, tmp_path):
    """References cut off at the end of a text, without a semicolon, of other names and as numbers; null pages."""
    said = ["<p>a&amp</p>", "a&am", "a&quot b", "a&copy<br>", "&amp;lt; &amp;amp; &lt;b&gt;", "it&#39;s &apos;x&apos; &#x27; &#39", "&nbsp;&auml;&middot;　\x85\x0bx ", "", "  ", None]
    spark.createDataFrame(list(enumerate(said)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = q.queries()["strip_html_text"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert canonical(got) == canonical(con.sql(q.oracle_sql()["strip_html_text"]).df())

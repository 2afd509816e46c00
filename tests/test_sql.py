"""The SQL surface: every function is known, and its body says what the Python expression does."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import sql
from tessera.functions import text as T

TEXTS = ["", None, "Agni. Rāma..", "a\n\n b 'q' \\ c\tsvar jñāna vya", "<p class='a'>x<br/>y</p><p>z &amp; &eacute;</p>", "दे॒वं यज्ञस्य", "/a/./b/../c", "12.5", "karśa m\n"]


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark, "x_")


def test_all_are_known(spark, names):
    assert len(names) == len(set(names)) >= 35
    known = {r.function for r in spark.sql("SHOW USER FUNCTIONS").collect()} | {r.function for r in spark.sql("SHOW FUNCTIONS LIKE 'x_*'").collect()}
    assert {n.lower() for n in names} <= {k.split(".")[-1] for k in known}
    assert sql.register(spark, "x_") == names


@pytest.mark.parametrize("name", [n for n, (p, _) in sql.SCALARS.items() if p.split(" ")[1] == "STRING" and "," not in p])
def test_bodies(spark, names, name):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows.createOrReplaceTempView("x_rows")
    got = spark.sql(f"SELECT i, x_{name}(t) FROM x_rows ORDER BY i").collect()
    want = rows.select("i", sql.SCALARS[name][1](F.col("t"))).orderBy("i").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_numbers_and_written_ones(spark, names):
    got = spark.sql("SELECT x_confidence(1.5D), x_confidence(double('NaN')), x_format_time(61.5D), x_timeline_step(0.3D), size(x_invert_selection(2D, 3D, 5D)), x_html_to_text('<b>a &amp; b</b>')").first()
    assert tuple(got) == (0.5, 0.25, "1:01.500", 0.5, 2, "a & b")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows.createOrReplaceTempView("x_rows")
    assert spark.sql("SELECT x_html_to_text(t) FROM x_rows").collect() == rows.select(T.html_to_text(F.col("t"))).collect()


def test_table_functions(spark, names):
    assert [tuple(r) for r in spark.sql("SELECT * FROM x_html_paragraphs('<p class=\"a b\">x<br>y</p><p>z</p>') ORDER BY 1").collect()] == [(0, "a b", "x y"), (1, "", "z")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM x_html_headings('<h2 id=1>A <b>b</b></h2><h3></h3>') ORDER BY 1").collect()] == [(0, 2, "A b"), (1, 3, None)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM x_path_nodes('/a/b/c.txt') ORDER BY 1").collect()] == [(1, "a", True), (2, "a/b", True), (3, "a/b/c.txt", False)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM x_text_lines('a\\n\\nb') ORDER BY 1").collect()] == [(0, "a"), (1, ""), (2, "b")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM x_text_tokens(' a  bc\\nd') ORDER BY 1").collect()] == [(0, "a"), (1, "bc"), (2, "d")]


def test_functions_are_inlined(spark, names):
    plan = spark.sql("SELECT x_normalize_text(t) FROM VALUES ('A') AS v(t)")._jdf.queryExecution().optimizedPlan().toString()
    assert "x_normalize_text(" not in plan.replace("AS x_normalize_text(", "").replace("x_normalize_text(t)#", "") and "Python" not in plan

"""Decisions are read as their SQL reads them, whatever spaces and letters stand around."""

from oracle import oracle_rows, spark_rows

from loomgraph.plans import registry


def test_decision_labels_with_other_spaces_and_letters(spark, tmp_path):
    texts = [" yes", "no　", "yesé", " n ", "maybé", "x éanswer is no", "final answer\x0bis no", "final answer is no", "true\n", "y\n", "\nno", "YESİ", "", "unknown​"]
    rows = [(i, 3, "user", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    found = spark_rows(registry.queries()["decision_labels"](spark, str(tmp_path)))
    assert found == oracle_rows(registry.oracle_sql()["decision_labels"], str(tmp_path))

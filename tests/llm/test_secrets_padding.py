"""Candidates that are all padding, or one character and padding, fail nothing and are not random."""

from defeasor.llm import secrets


def test_runs_of_equal_signs(spark):
    texts = ["Title\n" + "=" * 20 + "\ntext", "A" + "=" * 20, "-" + "=" * 30, "ab" + "=" * 20, "=" * 40 + " password: hunter2hunter2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()}
    assert found == {0: "", 1: "", 2: "", 3: "", 4: "assign:41:65"}

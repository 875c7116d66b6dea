"""Operator 9 where rows name their repositories."""

from scriptorium.llm import secrets_scan


def test_repositories_take_part(spark):
    many, one = "Zx8kQ2mN5vB7cR1tY4wP9", "Qw3eR5tY7uI9oP1aS2dF4"
    rows = [(i, f"value {many} end", "hot", f"r{i}") for i in range(5)] + [(i, f"value {one} end", "hot", "r0") for i in range(5, 10)]
    docs = spark.createDataFrame([*rows, (10, "password = hunter22", "hot", "r1")], "doc_id long, text string, source string, repo string")
    found = secrets_scan.digest(secrets_scan.scan(docs, repo_col="repo", example_repos=4)).collect()
    assert {r["doc_id"]: (r["n_added"], r["live"]) for r in found} == {i: (0, 0) if i < 5 else (0, 1) if i == 10 else (1, 1) for i in range(11)}
    clean = {r["doc_id"]: r["text"] for r in secrets_scan.redact(docs, repo_col="repo", example_repos=4).collect()}
    assert clean == {i: f"value {many} end" if i < 5 else "[secret]" if i == 10 else "value [secret] end" for i in range(11)}
    # Rows without a repository count as one of their own text: five texts of one owner are few, thirty many, thirty copies one.
    assert {r["live"] for r in secrets_scan.digest(secrets_scan.scan(docs.drop("repo"))).collect()} == {1}
    texts = [(i, f"value {many} end {i}", "hot") for i in range(30)] + [(i, f"value {one} end", "hot") for i in range(30, 60)]
    spread = secrets_scan.digest(secrets_scan.scan(spark.createDataFrame(texts, "doc_id long, text string, source string"))).collect()
    assert {r["doc_id"]: r["n_added"] for r in spread} == {i: int(i >= 30) for i in range(60)}

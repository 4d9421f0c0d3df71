from jsonweave.llm import components


def test_no_number_of_rounds_ends_it(spark, monkeypatch):
    monkeypatch.setattr(components, "range", lambda n: [0], raising=False)
    edges = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == dict.fromkeys(range(101), 0)

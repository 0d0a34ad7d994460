from lexquarry.operators import library, substrings


def test_runs_are_never_broadcast(spark):
    # the planner takes the runs for as few bytes as the strings that they come from
    a = spark.createDataFrame([(k, f"spin-liquid-{k}") for k in range(40)] + [(99, "x")], "id long, text string")
    b = spark.createDataFrame([("liquid-1",), ("the-spin-liquid-3-state",), ("x",)], "w string")
    d = substrings.either_contains(a, b)
    got = {(r.id, r.w) for r in d.collect()}
    assert got == {(k, "liquid-1") for k in range(40) if str(k)[0] == "1"} | {(3, "the-spin-liquid-3-state"), (99, "x")}
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_sources_of_concepts_are_never_broadcast(spark):
    refs = spark.createDataFrame([("spin liquid",), ("none",)], "ref string")
    files = spark.createDataFrame([("raw/papers/spin-liquid-state.md",)], "path string")
    d = library.concept_sources(refs, files)
    assert {r.ref: r.name for r in d.collect()} == {"spin liquid": "spin-liquid-state", "none": "none"}
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()

from loomlake.llm import stages


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (None, b + " more"), (2, c), (2, d), (2, d), (3, c), (None, c), (4, e), (5, ""), (None, " "), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in stages.near_duplicates(spark, docs, "").collect()]
    near = [x for x in got if x[1] and x[1].startswith("b0 ")]
    assert len(near) == 1 and near[0] in rows
    assert sorted(map(repr, (x for x in got if x not in near))) == sorted(map(repr, [(None, a), (2, c), (2, d), (4, e), (5, ""), (None, " "), (None, None)]))

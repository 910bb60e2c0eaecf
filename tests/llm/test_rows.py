"""The filtering stages drop rows, not doc_ids."""

from tidewake.llm import decontaminate, ngram_join

SCHEMA = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def text(seed):
    return " ".join(f"{seed}{k}" for k in range(20))


def test_clean_drops_only_hit_rows(spark):
    bench = spark.createDataFrame([(1, text("b"))], "item_id long, text string")
    clean = [(None, "clean one"), (None, None), (None, text("a")), (7, "clean two"), (7, text("c")), (8, "")]
    hit = [(None, "x " + text("b")), (7, text("b")), (7, text("b"))]
    assert rows(decontaminate.clean(spark.createDataFrame(clean + hit, SCHEMA), bench)) == sorted(clean, key=str)


def test_one_row_of_each_group_stays(spark):
    data = [
        (1, text("a")), (1, text("a")), (2, text("a")), (2, text("b")),  # 2 is a copy in one row and unique in the other
        (None, text("c")), (None, text("c")), (None, text("d")), (5, text("d")), (5, text("d")),
        (None, None), (None, ""), (9, None), (9, None),
    ]
    want = [(1, text("a")), (2, text("b")), (None, text("c")), (5, text("d")), (None, None), (None, ""), (9, None), (9, None)]
    assert rows(ngram_join.one_of_each(spark.createDataFrame(data, SCHEMA))) == sorted(want, key=str)

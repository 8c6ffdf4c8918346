import numpy as np
import pyarrow as pa

from gridtide.llm import decontaminate as d
from gridtide.llm.tables import text_slices

ITEMS = [
    (1, "A train leaves the old station at 14 km per hour and Anna waits for 3 hours until it comes. How far has the train gone when Anna sees it at 14 km?"),
    (2, "Too short here"),
    (3, "The farmer has twelve apples and gives some of them to the neighbour who lives behind the green hill by the river."),
    (4, None),
    (5, ""),
    (None, "An item without any id that should never be reported as found in a document"),
]
PAD = "Something else is written before it. "


def found(spark, documents, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in d.contaminated(documents(docs), items).collect())


def test_cases(spark, documents):
    q = ITEMS[0][1]
    docs = [
        (10, PAD + q + " And more."),
        (11, PAD + q.replace("14 km", "99 mi").replace("Anna", "Boris").replace("3 hours", "7 days")),  # other slots throughout
        (12, PAD + q.replace("14 km per", "99 km per")),  # 14 would be 99 and 14
        (13, q.upper()), (14, " ".join(q.split()[:14])), (15, ITEMS[2][1].lower() + "\nThe end. " + q),
        (16, "Too short here, he said"), (17, None), (18, ""), (19, ITEMS[5][1]), (None, q), (20, "word " * 200_000 + ITEMS[2][1]),
        (21, "The farmer has 12 pears"), (10, PAD + q), (22, q + " " + q.replace("14", "15")),
    ]
    assert found(spark, documents, docs) == [(10, 1, True), (11, 1, False), (15, 1, True), (15, 3, True), (16, 2, True), (20, 3, True), (22, 1, False)]
    assert found(spark, documents, []) == []
    kept = d.keep_clean(documents(docs), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 12, 13, 14, 17, 18, 19, 21]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(documents(docs), empty).collect() == []
    clash = documents([(1, ITEMS[2][1])]).selectExpr("doc_id", "text", "1 as item_id", "2 as id", "3 as pos", "4 as hash")
    assert d.contaminated(clash, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 1
    assert d.keep_clean(clash, empty).columns == clash.columns


def test_template():
    ((_, data, offsets),) = text_slices(pa.array(["He paid 3,500.50 euros to Anna. Éva knows Éva!", "euros 5"]))
    shape, value, slot, first = d.template(data, offsets)
    words = "he paid N U to A éva knows É euros N".split()
    assert first.tolist() == [0, 9, 11]
    assert slot.tolist() == [w in ("N", "U", "A", "É") for w in words]
    assert shape[2] == shape[10] == d._NUMBER and shape[3] == d._UNIT and shape[5] == shape[8] == d._NAME and value[6] == value[8]


def test_planted_passages_are_all_found(spark):
    sf = "/root/testdata/sf0.1"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()}
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {(i, k) for i, t in texts for k, q in asked if q[20:-20] in t}
    assert want and want <= got
    lowered = {i: t.lower() for i, t in texts}
    for i, k in got - want:  # what else is reported shares most of the words
        words = dict(asked)[k].lower().split()
        assert np.mean([w.strip(".,") in lowered[i] for w in words]) > 0.75


def test_items_in_any_case(spark, documents, tmp_path):
    from gridtide.llm.queries import op3_benchmark_contamination

    three, eight, eleven = "What is entropy?", "What is the capital of the old kingdom?", "Which of these rivers flows north into the wide cold sea?"
    rich = "Alice, Bob, Carol, David, Erin, Frank, Grace and Heidi met Ivan, Judy, Mallory and Niaj."
    asked = [(1, three), (2, eight), (3, eleven), (4, ITEMS[0][1]), (5, rich)]
    docs = [
        (10, f'he asked "{three}" again'), (11, f"| {eight}"), (12, f"then, {eleven}"), (13, ITEMS[0][1].upper()), (14, ITEMS[0][1].lower()),
        (15, f"he said {rich}"), (16, rich.lower()), (17, "what is the matter"), (18, "Which of these rivers flows south"),
        (19, ITEMS[0][1].replace("14 km per", "99 km per")), (20, ITEMS[0][1].replace("14 km", "99 mi").replace("Anna", "Boris")),
    ]
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in op3_benchmark_contamination(spark, str(tmp_path)).collect())
    assert got == [(10, 1, True), (11, 2, True), (12, 3, True), (13, 4, True), (14, 4, True), (15, 5, True), (16, 5, True), (20, 4, False)]


def test_rows_of_any_id_are_judged(spark, documents):
    docs = documents([(None, PAD + ITEMS[0][1]), (None, "Nothing of that kind"), (7, ITEMS[2][1]), (7, "Nothing of this kind"), (8, "Other words")])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = d.keep_clean_rows(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == ["Nothing of that kind", "Nothing of this kind", "Other words"]
    assert d.keep_clean_rows(docs.where("doc_id = 8"), items).count() == 1

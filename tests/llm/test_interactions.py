import re
from collections import defaultdict
from itertools import permutations

from gridtide.llm import interactions

ODD = ["", None, "  \t\n", "word", "#", "ABC def", "x" * 100_000, "ß€日本 Ωmega"]


def plain(docs, labels):
    """Every order run filter by filter over all rows: (id, text, part) and (id, quality, toxic)."""
    texts = [(i, t or "", p or "") for i, t, p in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, _ in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in texts if u == t and j is not None]
        fails.append("".join(name for name, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)),
            ("D", re.search(r"[#$%&*|]", t) is not None), ("E", bool(same) and (i is None or min(same) < i)),
        ) if bad))
    out, shapley = {}, defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        left = set(range(len(texts)))
        for step, f in enumerate(order, 1):
            gone = {r for r in left if f in fails[r]}
            for part in {p for _, _, p in texts}:
                own = [r for r in range(len(texts)) if texts[r][2] == part]
                lost = [r for r in own if r in gone]
                out[part, order, step] = [
                    len([r for r in own if r in left and r not in gone]), len(lost), len([r for r in own if f in fails[r] and r not in left]),
                    len([r for r in own if fails[r] == f]), len([r for r in lost if texts[r][0] in good]), len([r for r in lost if texts[r][0] in toxic]),
                ]
                shapley[part, f] += len(lost)
            left -= gone
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(frame):
    rows = frame.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_documents_equal_brute_force(spark, sf_dir):
    from gridtide.llm.queries import op11_filter_interactions

    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    result = op11_filter_interactions(spark, sf_dir)
    assert [c for c, kind in result.dtypes if kind == "bigint"] == ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got(result) == plain(docs, labels)


def test_edge_rows(spark):
    many = " ".join(f"w{i}" for i in range(120))
    eighty = " ".join([f"w{i}" for i in range(80)] + ["w0"] * 20)  # exactly 100 words, exactly 80 of them distinct
    docs = [(i, t, "en") for i, t in enumerate(ODD)] + [(i + 20, t, None) for i, t in enumerate(ODD)] + [(40, many, "en"), (39, many, "de"), (39, many, "de"), (41, many, ""), (None, many, "de")]
    docs += [(None, "alone", "fr"), (None, "alone", "fr"), (50, eighty, "en"), (51, eighty + " w0", "en"), (52, "A" + "b" * 9, "en"), (53, "AB" + "b" * 9, "en"), (54, "é" * 9 + "A", "en")]
    labels = [(40, 1, 0), (40, 0, 1), (39, None, None), (41, 0, 1), (None, 1, 1), (3, 1, 0), (77, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain(docs, labels)
    assert got(interactions.audit(frame, marks)) == want
    clash = frame.selectExpr("doc_id", "text", "lang", "1 as part", "2 as mask", "3 as digest", "4 as n", "5 as first", "6 as good")
    assert got(interactions.audit(clash, marks.selectExpr("*", "1 as part", "2 as n"))) == want
    unlabelled = got(interactions.audit(frame, marks.limit(0)))
    assert {k: v[:4] for k, v in unlabelled.items()} == {k: v[:4] for k, v in want.items()} and not any(v[4] or v[5] for v in unlabelled.values())
    assert interactions.audit(frame.limit(0), marks).collect() == []
    assert {r["part"] for r in interactions.audit(frame.drop("lang"), marks).collect()} == {""}

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerleaf.operators.chunking import chunk_text


def chunks(spark, text, **kw):
    rows = chunk_text(spark.createDataFrame([(1, text)], "doc_id int, text string"), **kw).collect()
    return [(r.chapter, r.text) for r in sorted(rows, key=lambda r: r.idx)]


def test_headings_start_chapters(spark):
    got = chunks(spark, "# 存款保险\r\n存款保险限额 50 万。\n# 贷款利率\nLPR 浮动。")
    assert got == [("# 存款保险", "# 存款保险\n存款保险限额 50 万。"), ("# 贷款利率", "# 贷款利率\nLPR 浮动。")]


def test_last_of_consecutive_headings_wins_and_empty_sections_go(spark):
    assert chunks(spark, "# a\n\n第一条：\n正文\n## b\n\n") == [("第一条：", "第一条：\n正文")]
    assert chunks(spark, " \n\t\n　") == []


def test_what_is_no_heading(spark):
    text = "##no space\n" + "x" * 30 + ":\n##### five"
    assert chunks(spark, text) == [("", text)]


def test_long_paragraphs_stay_whole_and_overlap_comes_from_the_new_one(spark):
    got = chunks(spark, "a" * 8 + "\n" + "b" * 20 + "\n\n" + "c" * 3, max_chars=10, overlap=2)
    assert [t for _c, t in got] == ["a" * 8, "bb\n" + "b" * 20, "cc\nccc"]
    assert [t for _c, t in chunks(spark, "a" * 8 + "\n" + "b" * 20, max_chars=10, overlap=0)] == ["a" * 8, "b" * 20]


def by_hand(text, limit, overlap):
    """The packing rule on plain paragraphs, written out."""
    body = text.strip()
    if len(body) <= limit:
        return [body] if body else []
    out, open_piece = [], ""
    for para in [p for p in body.split("\n") if p.strip()]:
        if len(open_piece) + len(para) + 1 <= limit:
            open_piece = f"{open_piece}\n{para}".strip() if open_piece else para
            continue
        if open_piece:
            out.append(open_piece)
        open_piece = f"{para[-overlap:]}\n{para}" if overlap else para
    return out + ([open_piece] if open_piece else [])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é中\n\t ", max_size=40), min_size=30, max_size=40), st.integers(5, 60), st.integers(0, 9))
def test_packing_matches_the_rule(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = chunk_text(df, limit, overlap).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("c"))
    got = {r.doc_id: [x.text for x in r.c] for r in rows.collect()}
    assert {i: got.get(i, []) for i in range(len(texts))} == {i: by_hand(t, limit, overlap) for i, t in enumerate(texts)}

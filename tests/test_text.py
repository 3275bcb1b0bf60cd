from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.operators.chunks import chunk


def value(spark, expr, x):
    return spark.createDataFrame([(x,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_tokens_mix_words_and_ideographs(spark):
    got = value(spark, text.tokens, "Feat 专长表 x2")
    assert sorted(got) == sorted(["feat", "x2", "专长表", "专", "长", "表", "专长", "长表"])


def test_long_ideograph_run_is_no_token_of_its_own(spark):
    run = "一二三四五六七八九"
    got = value(spark, text.tokens, run)
    assert run not in got and len(got) == 9 + 8


def test_compact_folds_width_and_sharp_s(spark):
    assert value(spark, text.compact, "Ｓtraße (专长)！") == "strasse专长"
    assert value(spark, text.compact_letters, "Straße-é 专") == "strasseé专"


def test_shingles(spark):
    assert value(spark, text.shingles, "") == [""]
    assert value(spark, text.shingles, "One, two") == ["one two"]
    assert value(spark, text.shingles, "专长规则") == ["专长规", "长规则"]
    assert value(spark, text.shingles, "a b c d") == ["a b c", "b c d"]


def test_token_estimate(spark):
    assert value(spark, text.token_estimate, "") == 0
    assert value(spark, text.token_estimate, "a") == 1
    assert value(spark, text.token_estimate, "专长 规则\n表") == 2


def docs(spark, content, blocks=None):
    row = ("d", "r", "s", "T", "P", content, 0, blocks)
    schema = (
        "id string, ruleset_id string, source_id string, title string, full_path string, content string, priority int, "
        "structural_blocks array<struct<heading_path:array<string>,content:string,table_index:int,row_index:int>>"
    )
    return spark.createDataFrame([row], schema)


def test_chunks_overlap_and_stop(spark):
    got = chunk(docs(spark, "  abcdefghij  "), 6, 2).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.content) for r in got] == [("d:00000", "abcdef"), ("d:00001", "efghij")]
    assert got[0].search_text == "T\nP\nabcdef"


def test_chunk_index_runs_over_blocks(spark):
    blocks = [(["A", "B"], "xxxxxxx", None, None), (None, " ", None, None), ([], "yy", None, None)]
    got = chunk(docs(spark, "ignored", blocks), 4, 1).orderBy("chunk_index").collect()
    assert [r.content for r in got] == ["xxxx", "xxxx", "yy"]
    assert [r.search_text.split("\n")[1] for r in got] == ["A > B", "A > B", "P"]


def test_chunk_rejects_overlap_as_large_as_size(spark):
    import pytest

    with pytest.raises(ValueError):
        chunk(docs(spark, "x"), 5, 5)


def test_wide_forms_fold_like_nfkc(spark):
    import unicodedata

    texts = ["（Ａ）：，１２　ｂ", "Ａ̊ x", "ﬁ ２", "plain", "法师（ＦＩＲＥ）", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", text.nfkc_casefold(F.col("t"))).collect())
    assert got == {i: t and unicodedata.normalize("NFKC", t).casefold() for i, t in enumerate(texts)}

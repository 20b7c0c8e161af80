from corvane.functions import text as T
from corvane.sources import adapters


def test_walk_prunes_and_reads_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("one\r\ntwo\n")
    (tmp_path / "a/bin.py").write_bytes(b"ab\0cd")
    (tmp_path / "a/empty.py").write_text("")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/y.py").write_text("no")
    files = adapters.walk(spark, str(tmp_path), "*.py")
    assert [r.name for r in files.collect()] == ["x.py"]
    assert [(r.line, r.text) for r in adapters.lines(files).orderBy("line").collect()] == [(1, "one"), (2, "two")]


def test_column_functions(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        T.edit_distance(F.lit("é"), F.lit("e")).alias("bytes"), T.slugify(F.lit("A  b—C!")).alias("slug"), T.estimate_tokens(F.lit("abcde")).alias("tokens"),
        T.terminal_callable_key(F.lit("a::b.c")).alias("key"), T.in_order(F.lit("ab ab"), "ab", "ab").alias("twice"), T.in_order(F.lit("aba"), "ab", "ba").alias("overlap"),
    ).first()
    assert row.asDict() == {"bytes": 2, "slug": "a-b-c", "tokens": 2, "key": "c", "twice": True, "overlap": False}
    assert T.glob_regex("*.{py,rs}") == r"^.*\.(?:py|rs)$"

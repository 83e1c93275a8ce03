from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators.extract import split_lines

#: Every ending after every content, alone and in twos: only LF and CRLF end a line.
CONTENTS = ["", "one", "t\ttab", "c\rr", "sep\u2029x", "f\x1cg\x0bh"]
ENDS = ["\n", "\r\n", ""]
LINES = [("", [])] + [(c + e, [c]) for c in CONTENTS for e in ENDS if c or e] + [(a + e + b + f, [a, b]) for a in CONTENTS for e in ENDS[:2] for b in CONTENTS[1:] for f in ENDS]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'binary'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_lines_agree_in_columns_and_python(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "i int, t string")
    got = {r.i: r for r in rows.select("i", X.lines(F.col("t")).alias("l"), X.line_count(F.col("t")).alias("n"), F.array_join(X.lines_with_ends(F.col("t")), "").alias("whole")).collect()}
    for i, (t, want) in enumerate(LINES):
        assert got[i].l == want == split_lines(t)
        assert got[i].n == len(want) and got[i].whole == t == "".join(split_lines(t, True))


def test_test_paths(spark):
    names = (("loom.rs", False), ("conftest.py", True), ("test_loom", True), ("loom_test.c", True), ("loom_spec.ex", True), ("loom.test.js", True), ("loom.spec.vue", True), ("tester.py", False), ("my_conftest.py", False), ("spec.loom.js", False))
    folders = (("", False), ("lib/", False), ("lib/test/", True), ("tests/", True), ("a/__tests__/b/", True), ("attest/", False), ("tests.d/", False))
    rows = [(f"{folder}{name}", inside or marked) for folder, inside in folders for name, marked in names]
    wrong = spark.createDataFrame(rows, "p string, want boolean").where(X.is_test_path(F.col("p")) != F.col("want")).collect()
    assert wrong == []


def test_names_ids_and_links(spark):
    assert one(spark, X.module_name(F.col("p")), p="a/b/__init__.py") == "a.b"
    assert one(spark, X.module_name(F.col("p")), p="a/b.py") == "a.b"
    import hashlib

    assert one(spark, X.stable_id(F.col("a"), F.col("b"), F.lit(3)), a="x", b=None) == hashlib.sha256(b"x\0None\x003").hexdigest()[:16]
    link = X.permalink(F.col("r"), F.col("s"), F.col("p"), F.lit(1), F.lit(2))
    assert one(spark, link, r="o/n", s="a" * 40, p="d i/ü~*+.py") == "https://github.com/o/n/blob/" + "a" * 40 + "/d%20i/%C3%BC~%2A%2B.py#L1-L2"
    assert one(spark, link, r="o/n/x", s="a" * 40, p="p") is None and one(spark, link, r="o/n", s="zz", p="p") is None


def test_safe_paths(spark):
    for path, safe in (("a/b.py", True), ("/a", False), ("\\a", False), ("C:/a", False), ("a/../b", False), ("./a", False), ("", False), ("a/..b", True)):
        assert one(spark, X.is_safe_path(F.col("p")), p=path) is safe, path


def test_sentences_fences_and_references(spark):
    assert one(spark, X.sentences(F.col("t")), t=" One two.  Three? four!x five. ") == ["One two.", "Three?", "four!x five."]
    assert one(spark, X.sentences(F.col("t")), t="  ") == []
    text = "prose\n```\ncode\n```\nmore"
    assert one(spark, X.prose_length(F.col("t")), t=text) == len(text) - len("```\ncode\n```")
    assert one(spark, X.pull_reference(F.col("t")), t="own/name#12").asDict() == {"repository": "own/name", "number": 12}
    assert one(spark, X.pull_reference(F.col("t")), t="https://host.example/own/name/pull/7").number == 7
    assert one(spark, X.pull_reference(F.col("t")), t="own/name").repository is None


def test_escapes_and_text_bytes(spark):
    assert one(spark, X.script_safe(F.col("t")), t="</script>&\u2028") == "\\u003c/script\\u003e\\u0026\\u2028"
    assert one(spark, X.html_escape(F.col("t")), t="<a href='x'>\"&") == "&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;"
    for data, ok in ((b"abc", True), (b"a\0b", False), (b"\xff\xfe", False), ("ü".encode(), True)):
        assert one(spark, X.is_text(F.col("b")), b=bytearray(data)) is ok


def test_rows_that_differ_by_one_carriage_return(spark):
    same = X.same_line(F.col("a"), F.col("b"))
    for row, source, ok in (("x", "x\n", True), ("x", "x\r\n", True), ("x\r", "x\r\n", True), ("x\r", "x\n", False), ("x", "x", True), ("x", "y\n", False)):
        assert one(spark, same, a=row, b=source) is ok, (row, source)


def test_excerpts_keep_whole_words(spark):
    text = " ".join(f"word{i}" for i in range(200))
    got = one(spark, X.excerpt(F.col("t"), "WORD100"), t=text)
    assert "word100" in got and len(got) <= 240 and all(w in text.split() for w in got.split())
    assert one(spark, X.excerpt(F.col("t"), "absent"), t=text) is None

import pytest
from pyspark.sql import functions as F

from sheafline.functions import text as t


def values(spark, rows, make):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, s string" + (", p string" if isinstance(rows[0], tuple) else ""))
    return [r.v for r in df.select("i", make(F.col("s")).alias("v")).orderBy("i").collect()]


BODIES = [
    ("", ""), ("# T\nbody", "body"), ("---\nk: v\n---\n\n# T\n\nbody\n", "body"), ("---\nk: v\nbody", "k: v\nbody"),
    ("  ---  \nk: v\n ---\nbody", "body"), ("\n---\nk: v\n---\nb", "---\nk: v\n---\nb"), ("---\n---\n#tag\nb", "b"),
    ("---\n---\n# A\n# B\nb", "# B\nb"), ("---\n---\n\tx\n", "x"), ("---\n---\n x ", "x"), ("#", ""), ("---", ""), (None, ""), ("\x1ca\x1f", "a"),
]


def test_bodies(spark):
    assert values(spark, [a for a, _ in BODIES], t.extract_body) == [b for _, b in BODIES]


def test_title_is_pythons(spark):
    rows = ["shadcn-ui", "3d api", "", "o'neil x2y", "ÉCOLE d'été", "a", "node-express"]
    assert values(spark, rows, t.title) == [r.title() for r in rows]
    assert values(spark, rows, t.spaced_title) == [r.replace("-", " ").title() for r in rows]


def test_strip_and_line_count_are_pythons(spark):
    rows = ["", " a ", " a ", "a\n", "a\r\nb", "a\rb\r", "a\x0bb\x0cc", "\x1c\x1d\x1e", "a\x85b c ", "\n\n", "x\n\ny"]
    assert values(spark, rows, t.strip) == [r.strip() for r in rows]
    assert values(spark, rows, t.line_count) == [len(r.splitlines()) for r in rows]


GLOBS = [
    ('---\nglobs:\n  - "a"\n  - "b"\n---', '---\nglobs:\n  - "G"\n  - "b"\n---'), ("---\nglobs: a\n---\nx", '---\nglobs: a\n  - "G"\nx'),
    ("no keys", "no keys"), ("text globs: y\n- bullet", 'text globs: y\n  - "G"'),
]


def test_glob_rewrite(spark):
    assert values(spark, [a for a, _ in GLOBS], lambda c: t.rewrite_glob(c, F.lit("G"))) == [b for _, b in GLOBS]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_head_lines(spark, n):
    rows = ["a", "a\nb", "a\nb\nc", ""]
    want = ["\n".join(r.split("\n")[:n]) + ("+" if len(r.split("\n")) > n else "") for r in rows]
    assert values(spark, rows, lambda c: t.head_lines(c, n, "+")) == want


def test_small_ones(spark):
    assert values(spark, ["1", " 7 ", "1_0", "x", "", "-3", "99999999999"], t.parse_int) == [1, 7, 10, None, None, -3, None]
    assert values(spark, ["sk-12345678", "short", "", None], t.mask) == ["**********5678", "****", "****", "****"]
    assert values(spark, ["Y", " yes ", "TRUE", "1", "n", ""], t.parse_flag) == [True] * 4 + [False] * 2
    assert values(spark, ["a/b/*.py", "x"], t.before_glob) == ["a/b", "x"]
    assert values(spark, ["a, b ,c", ""], lambda c: F.array_join(t.comma_split(c), "|")) == ["a|b|c", ""]
    assert values(spark, ["alwaysApply: no\nb", "b"], lambda c: t.rewrite_lines(c, "alwaysApply:", "alwaysApply: true")) == ["alwaysApply: true\nb", "b"]
    assert values(spark, ["Flask-Cors Django", None], lambda c: F.array_join(t.keyword_hits(c, ["fastapi", "django", "flask"]), ",")) == ["django,flask", ""]
    assert values(spark, ["/r/apps/x", "/other/x", "\\r\\a"], lambda c: t.relative(c, F.lit("/r"), F.lit("name"))) == ["apps/x", "name", "a"]

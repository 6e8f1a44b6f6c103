"""Patterns tried on candidates only, against a plain scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from secspark.functions.predicates import java_pattern
from secspark.operators.normalize import required_text, scan_patterns


@pytest.mark.parametrize("pattern, want", [
    ("password", ("password", False)), ("(?i)PassWord", ("PassWord", True)), (r"a\.exe", ("a.exe", False)), (r"ab|abc", None), (r"(abc|abd)e", None), (r"(abcd)?ef", None), (r"(abcd)+ef", ("abcd", False)),
    (r"x{2,}yyy", ("yyy", False)), (r"\d{3}-\w+@evil\.org$", ("@evil.org", False)), (r"abc(?=defg)", ("abc", False)), (r"(?!abc)xyz", ("xyz", False)), (r"[abc]def", ("def", False)), (r"ab", None), (r"(?i)straße", None),
    (r"ab(?:cd)ef", ("abcdef", False)), (r"ab(?<n>cd)ef", None), (r"ab(?P<n>cd)ef", ("abcdef", False)), (r"abc(?i:DEF)ghi", None), (r"\Qabc\E", None), (r"(", None), (r"abc*def", ("def", False)), (r"a\Sbcd", ("bcd", False)),
])
def test_required_text(pattern, want):
    assert required_text(pattern) == want


def test_five_hundred_patterns(spark):
    r = random.Random(5)
    words = ["evil", "Login", "cmd.exe", "/etc/passwd", "ÄRGER", "select", "union", "K", "ſs", "a1b2", ""]
    parts = [lambda: re.escape(r.choice(words)), lambda: r"\d+", lambda: "(?:" + re.escape(r.choice(words)) + "|" + re.escape(r.choice(words)) + ")", lambda: "(" + re.escape(r.choice(words)) + ")?", lambda: ".{0,4}", lambda: "[a-c]x*", lambda: "(" + re.escape(r.choice(words)) + "x){1,2}"]
    patterns = {f"p{i}": ("(?i)" if r.random() < 0.4 else "") + "".join(r.choice(parts)() for _ in range(r.randint(1, 4))) for i in range(500)}
    patterns = {k: p for k, p in patterns.items() if p not in ("", "(?i)")}
    texts = ["".join(r.choice([w, w.upper(), w.lower()]) + r.choice(["", " ", "7", "x"]) for w in r.choices(words, k=r.randint(0, 8))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, a string").withColumn("b", F.reverse("a"))
    got = sorted(map(tuple, scan_patterns(df, patterns, ["a", "b"]).collect()))
    plain = [F.when(F.coalesce(F.col(c).rlike(java_pattern(p)), F.lit(False)), F.struct(F.lit(c).alias("c"), F.lit(k).alias("p"))) for c in ("a", "b") for k, p in patterns.items()]
    want = df.select("id", F.explode(F.filter(F.array(*plain), lambda x: x.isNotNull())).alias("x")).select("id", "x.c", "x.p")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 500
    assert sum(required_text(p) is not None for p in patterns.values()) > 100

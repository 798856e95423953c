"""Generated-input checks of the name sanitiser and the text parsers."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from supplylens.functions.columns import parse_number, quarter_start
from supplylens.operators.grid import NAME_DROP_CHARS, sanitize_names

names = st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=12),
                 min_size=1, max_size=8)


@given(names)
@settings(max_examples=200, deadline=None)
def test_sanitized_names_are_unique_and_clean(raw):
    out = sanitize_names(raw)
    assert len(out) == len(raw)
    assert len({n.lower() for n in out}) == len(out)          # unique, case-insensitively
    for n in out:
        assert n and not any(c in n for c in NAME_DROP_CHARS)
        assert not re.search(r"\s", n) and "__" not in n.rstrip("_0123456789")
        assert not n.startswith("_")


@given(st.lists(st.one_of(st.integers(min_value=-10**12, max_value=10**12),
                          st.text(alphabet="0123456789,.- x", max_size=10)), min_size=1, max_size=30))
@settings(max_examples=25, deadline=None)
def test_parse_number_matches_python(spark, values):
    texts = [f"{v:,}" if isinstance(v, int) else v for v in values]

    def expected(t):
        s = t.strip().replace(",", "").strip()  # CAST trims blanks, as SQL does
        return int(s) if re.fullmatch(r"[+-]?[0-9]+", s) and -2**63 <= int(s) < 2**63 else None
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r.n for r in df.select(parse_number("t").alias("n")).collect()]
    assert got == [expected(t) for t in texts]


@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["1999", "2024", "x", " 2001 "])),
                          st.one_of(st.none(), st.sampled_from(["Q1", "Q2", "Q3", "Q4", "q2", "Q5", ""]))),
                min_size=1, max_size=20))
@settings(max_examples=25, deadline=None)
def test_quarter_start_never_raises(spark, pairs):
    df = spark.createDataFrame(pairs, "y STRING, q STRING")
    rows = df.select("y", "q", quarter_start("y", "q").alias("d")).collect()
    for r in rows:
        y = (r.y or "").strip()
        q = (r.q or "").strip().upper()
        if y.isdigit() and q in ("Q1", "Q2", "Q3", "Q4"):
            assert (r.d.year, r.d.month, r.d.day) == (int(y), {"Q1": 1, "Q2": 4, "Q3": 7, "Q4": 10}[q], 1)
        else:
            assert r.d is None


@given(st.lists(st.one_of(st.text(alphabet="0123456789+-.eE xaInfityN", max_size=10),
                          st.floats(allow_nan=True).map(str), st.integers().map(str)),
                min_size=1, max_size=40))
@settings(max_examples=30, deadline=None)
def test_guarded_cast_equals_try_cast(spark, texts):
    from supplylens.functions.columns import try_number
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for to in ("int", "bigint", "double"):
        rows = df.select(try_number("t", to).alias("a"), F.col("t").try_cast(to).alias("b")).collect()
        for r in rows:
            assert (r.a == r.b) or (r.a != r.a and r.b != r.b), (to, r)

"""Very long and malformed texts cost time in proportion to their length, and give the same results as plain patterns."""

import random
import re
import time

import pytest

from supplylens.llm import html_extract, pii

PIECES = ["<a ", "<p>", "</p>", "'", '"', ">", "<div class='x'>", "</div>", "word ", "<", "</", "<!x>", "<br/>"]
TAG = re.compile(r"""[a-zA-Z][^\s/<>]*((?:[^>"']|"[^"]*"|'[^']*')*)>""")


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a" * 500_000, "<!" * 500_000, '<a ">" ' * 150_000 + "'",
                                  "<script>" + "</script " * 100_000, "</a " * 250_000])
def test_tags_without_end(html):
    began = time.process_time()
    html_extract.main_text(html)
    assert time.process_time() - began < 10


def test_tag_ends():
    rng = random.Random(5)
    for _ in range(3000):
        html = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 20)))
        marks, ends = html_extract._tag_ends(html)
        for m in re.finditer(r"<([a-zA-Z][^\s/<>]*)", html):
            whole = TAG.match(html, m.start(1))
            i = next((i for i, at in enumerate(marks) if at >= m.end()), len(marks))
            assert ends[i] == (whole.end() if whole else -1), html


def test_text_that_looks_like_a_tag_stays():
    assert html_extract.main_text("<body><div><p>one <b two</p></div></body>") == "one"
    assert html_extract.main_text("<body><div><p>1 < 2 and more</p></div></body>") == "1 < 2 and more"


def test_addresses_in_very_long_words():
    long = "a" * 1_000_000
    began = time.process_time()
    assert pii.find(f"{long} @b") == []
    assert pii.find(f"{long}@b.com") == [(0, len(long) + 6, "email", f"{long}@b.com")]
    assert time.process_time() - began < 10


def test_addresses_as_the_plain_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
    rng = random.Random(6)
    for _ in range(5000):
        text = "".join(rng.choice(["a", "b.c", "@", "x.de", "-", " ", "A1", ".", "@b.com"]) for _ in range(rng.randint(1, 14)))
        assert [h[:2] for h in pii.find(text) if h[2] == "email"] == [m.span() for m in plain.finditer(text)]


def test_key_is_required(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com")], "doc_id long, text string")
    with pytest.raises(TypeError):
        pii.pseudonymize(spark, docs)
    with pytest.raises(ValueError):
        pii.pseudonymize(spark, docs, key="")

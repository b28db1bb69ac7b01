"""Exact text semantics, row by row."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repomine.functions import responses, text, urls
from repomine.functions.dates import java_date_text, stamp_text


@pytest.mark.parametrize(
    "field, terms",
    [("", [""]), ("a,,b,", ["a", "", "b"]), (",", []), (",,", []), (" a, b", [" a", " b"]), (",a", ["", "a"])],
)
def test_split_terms(values, field, terms):
    assert text.split_terms(field) == terms
    assert values([field], lambda x: text.split_terms_col(x)) == [terms]


def test_split_terms_can_trim():
    assert text.split_terms(" a, b", trim=True) == ["a", "b"]


def test_contains_any(values):
    rows = ["prefix change", "nothing", "", None]
    assert values(rows, lambda x: text.contains_any(x, [])) == [False] * 4
    assert values(rows, lambda x: text.contains_any(x, [""])) == [True, True, True, False]
    assert values(rows, lambda x: text.contains_any(x, ["FIX"])) == [True, False, False, None]
    assert values(["fix a bug", "fix"], lambda x: text.contains_any(x, [" bug"])) == [True, False]
    assert values(["ovrlap"], lambda x: text.contains_any(x, ["vr", "zz"])) == [True]


def test_contains_any_pattern_equals_separate_searches(values):
    terms = [f"{a}{b}" for a in "abcde.[]" for b in "xyz^-\\ \n"] + ["abc", "abcd", "été", "a.b"]
    rows = ["abcd", "zz a\n", "[^", "été ici", "ÉTÉ", "a.b", "a+b", "", "-", "\\", "c\\", "]]", ".^", None]
    assert len(terms) > text.MAX_SEPARATE_TERMS
    want = [None if r is None else any(t.lower() in r.lower() for t in terms) for r in rows]
    assert values(rows, lambda x: text.contains_any(x, terms)) == want


# The pattern uses only syntax that Python reads alike, so its logic can be tried without a job per case.
@settings(max_examples=500, deadline=None)
@given(
    st.lists(st.text(st.sampled_from("abc.^]-é "), min_size=1, max_size=9), min_size=1, max_size=8),
    st.text(st.sampled_from("abc.^]-é "), max_size=12),
    st.data(),
)
def test_terms_pattern(terms, other, data):
    pattern = text.terms_pattern(terms)
    whole = data.draw(st.sampled_from(terms))
    for message in (other, other + whole, whole + other, whole[1:] + other, whole[:-1] + other):
        assert bool(re.search(pattern, message)) == any(t in message for t in terms)


def test_long_terms_in_the_engine(values):
    terms = [f"term {i:03} with {'xyz'[i % 3]} inside" for i in range(200)]
    rows = [t.upper() for t in terms[::20]] + [t.replace("with", "wiht") for t in terms[::20]] + [terms[7][1:]]
    want = [any(t in r.lower() for t in terms) for r in rows]
    assert values(rows, lambda x: text.contains_any(x, terms)) == want


def test_truncate_text(values):
    short, edge, long = "a" * 1999, "b" * 2000, "c" * 2001
    assert values([short, edge, long, None], lambda x: text.truncate_text(x)) == [short, edge, "c" * 1997 + "...", None]
    # one character beyond the basic plane counts once
    assert values(["😀" * 2000], lambda x: text.truncate_text(x)) == ["😀" * 2000]


def test_trim_line(values):
    assert values(["\t a b\x00\r", "   ", " a"], lambda x: text.trim_line(x)) == ["a b", "", " a"]


def test_join_terms(values):
    assert values([["VR", "AR"], ["VR"], []], lambda x: text.join_terms(x), "array<string>") == ["VR OR AR", "VR", ""]


def test_refactoring_tags(values):
    rows = ["Refactor: extract method foo, rename bar", "fix", None]
    assert values(rows, lambda x: text.refactoring_tags(x)) == [["extract", "general", "rename"], [], []]
    assert values(["x"], lambda x: text.refactoring_tags(x, {})) == [[]]


def test_is_repo_url(values):
    kept = ["https://github.com/o/r", "http://github.com/o/r.git", "github.com/o/r", "https://github.com/o/r/"]
    dropped = [
        "https://gitlab.com/o/r", "https://www.github.com/o/r", "git@github.com:o/r.git", "https://github.com/o",
        "x https://github.com/o/r", "https://github.com/o/r ", "",
    ]
    assert values(kept + dropped, lambda x: urls.is_repo_url(x)) == [True] * len(kept) + [False] * len(dropped)


def test_normalize_repo_url(values):
    rows = ["github.com/o/r", "https://github.com/o/r/", "http://github.com/o/r.git", "https://github.com/o/r"]
    assert values(rows, lambda x: urls.normalize_repo_url(x)) == [
        "https://github.com/o/r.git", "https://github.com/o/r.git",
        "http://github.com/o/r.git", "https://github.com/o/r.git",
    ]
    assert values(rows, lambda x: urls.normalize_repo_url(x, legacy=True)) == [
        "https://github.com/github.com/o/r.git", "https://github.com/o/r/.git",
        "http://github.com/o/r.git", "https://github.com/o/r.git",
    ]


def test_names_and_commit_url(values):
    rows = ["https://github.com/o/p.github.io.git", "https://github.com/o/a b+c.git"]
    assert values(rows, lambda x: urls.repo_name(x)) == ["p.github.io", "a_b_c"]
    assert values(rows, lambda x: urls.repo_key(x)) == ["o/p.github.io", "o/a b+c"]
    assert values(rows[:1], lambda x: urls.commit_url(x, F.lit("H"))) == ["https://github.com/o/p.github.io/commit/H"]
    assert values(rows[:1], lambda x: urls.commit_url(x, F.lit("H"), legacy=True)) == ["https://github.com/o/phub.io/commit/H"]


def test_dates(values):
    rows = ["2024-01-02 03:04:05", "1999-12-31 23:59:59.9"]
    assert values(rows, lambda x: java_date_text(x.cast("timestamp"))) == ["Tue Jan 02 03:04:05 UTC 2024", "Fri Dec 31 23:59:59 UTC 1999"]
    assert values(rows, lambda x: stamp_text(x.cast("timestamp"))) == ["20240102_030405", "19991231_235959"]


def test_last_page(values):
    last = '<https://x/c?per_page=1&page=2>; rel="next", <https://x/c?per_page=1&page={}>; rel="last"'
    rows = [
        last.format("734"), last.format("+5"), last.format(" 5"), last.format("x"), last.format("99999999999"),
        '<https://x/c?page=9&per_page=1>; rel="last"', '<https://x/c>; rel="last"', 'page=5', 'page=5&a=b>',
    ]
    assert values(rows, lambda x: responses.last_page(x)) == [734, 5, 0, 0, 0, 1, 0, 0, 5]


def test_commit_count(values):
    assert values([None, "", 'rel="next"'], lambda x: responses.commit_count(x, F.lit("[{}]"))) == [1, 1, 1]
    assert values([None], lambda x: responses.commit_count(x, F.lit("{}"))) == [0]
    assert values([None], lambda x: responses.commit_count(x, F.lit("[{}, {}]"))) == [2]
    assert values([None], lambda x: responses.commit_count(x, F.lit(None).cast("string"))) == [0]


def test_json_defaults(values):
    rows = ['{"k": 69}', '{"k": "12"}', '{"k": 3.7}', '{"k": null}', '{"k": "x"}', "{}", "junk", None]
    assert values(rows, lambda x: responses.json_int(x, "k")) == [69, 12, 3, 0, 0, 0, 0, 0]
    assert values(['{"k": "a"}', "{}"], lambda x: responses.json_text(x, "k")) == ["a", None]

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import urlfilter as U
from riskloom.llm.common import text_slices


def brute(rule, url):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in rule), url, re.S) is not None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab*?", max_size=9), max_size=12), st.lists(st.text("abc", max_size=14), min_size=1, max_size=12))
def test_automaton_equals_regular_expressions(rules, urls):
    machine = U.Automaton(rules)
    for first, last, data, offs in text_slices(pa.array(urls)):
        assert machine.match(data, offs).tolist() == [[brute(r, u) for r in rules] for u in urls[first:last]]


def test_rules_longer_than_a_word():
    rule = "*" + "ab" * 70 + "?z*"
    urls = ["x" + "ab" * 70 + "qz!", "ab" * 70 + "z", "ab" * 71 + "z"]
    _, _, data, offs = next(text_slices(pa.array(urls)))
    assert U.Automaton([rule, "*z"]).match(data, offs).tolist() == [[brute(r, u) for r in (rule, "*z")] for u in urls]
    assert U.Automaton([]).match(data, offs).shape == (3, 0)


def test_query_against_brute_force_and_edges(spark):
    urls = ["HTTP://A.Example.com:80/x#top", "https://h.com:443", "https://ad1.net/x", None, "", "https://www.u.edu/login", "no scheme/login", "https://h/" + "q" * 5000 + ".zip", "http://H./a", "https://h.com:443"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(None, "http://x/cart", "c")], "page_id long, url string, matched string")
    out = U.filter_urls(df).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == 11 and by[0]["url"] == "http://a.example.com/x" and by[1]["url"] == by[9]["url"] == "https://h.com/" and by[8]["url"] == "http://h/a"
    for r in out:
        want = [x for x, _ in U.RULES if r["url"] is not None and brute(x, r["url"])]
        act = {a for x, a in U.RULES if x in want}
        assert (r["n_matched"], r["matched"]) == (len(want), " ".join(want)) and r["blocked"] == ("block" in act and "allow" not in act)
    assert by[2]["blocked"] and not by[5]["blocked"] and by[7]["blocked"] and not by[3]["blocked"]
    assert U.filter_urls(df.limit(0)).count() == 0
    assert U.filter_urls(df, []).filter("n_matched > 0 or blocked").count() == 0

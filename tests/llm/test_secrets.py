"""Spans against a plain scan by every rule, and what the trigram queries demand."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymerge.llm.secrets import BASE, RULES, digests, find_secrets, redact, trigram_query, trigrams

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [None, "", "Token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x", "pasſword=abcdefgh K PASSWD:abc", "é AKIA" + "Z" * 16 + " AKIA" + "Z" * 15,
         "api_key: 'abcdef' apiKey=\"ABCDEFGH\" secret token=token=abcdef", "0" * 23 + " " + "f" * 24 + "g" + "a1" * 5_000, "key AK IA", "-----BEGIN RSA PRIVATE KEY-----",
         "password=secret=abcdef", "Bearer " + "a" * 30, "\U0001f600token:abcdef"]


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_against_plain_scan(spark):
    rows = [(i or None, t, "x", 0) for i, t in enumerate(TEXTS + TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, rules int")
    got = sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in digests(find_secrets(docs)).collect())
    want = []
    for i, t in enumerate(TEXTS + TEXTS):
        found = brute(t)
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        want.append((i, *(sum(f[2] == k for f in found) for k in ("assign", "access", "hex")), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)
    assert find_secrets(docs.limit(0)).count() == 0
    clean = redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert find_secrets(clean.select("doc_id", "text"), BASE).where("size(spans) > 0").count() == 0


def test_queries():
    assert trigram_query(r"[0-9a-f]+") is None and trigram_query("ab") is None
    assert trigram_query("AKIA[A-Z]+") == ("and", "aki", "kia")
    assert {"tok", "ken", "sec", "api"} <= trigrams(trigram_query(BASE[0].pattern))


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_every_match_fulfils_its_query(rule, data):
    match = re.search(rule.pattern, data.draw(st.from_regex(rule.pattern)))[0].lower()

    def holds(q):
        return (all if q[0] == "and" else any)(p in match if isinstance(p, str) else holds(p) for p in q[1:])

    query = trigram_query(rule.pattern)
    assert query is None or holds(query)

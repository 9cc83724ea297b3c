"""Edits against a search over all edit sequences, whole results against a plain version."""

import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymerge.llm import turns as T

GOOD = re.compile("(s?(ua)+)?")
BODY = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """Fault of each (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        body = BODY.findall(text)
        out.append(T.BLANK if not body else T.DUPLICATE if (role, text) in seen else T.TRUNCATED if body[-1] not in ".!?" else T.FINE)
        seen.add((role, text))
    return out


def cheapest(rows, kinds, costs, inserts=2):
    """(cost, audit, repaired) by trying every edit of every row and up to ``inserts`` inserts at each place."""
    found = []

    def go(i, cost, audit, kept, room):
        if room:
            for role in ("user", "assistant"):
                go(i, cost + costs.insert, audit + "I", kept + [(role, "")], room - 1)
        if i == len(rows):
            if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in kept)):
                found.append((cost, audit, kept))
            return
        _, role, text = rows[i]
        go(i + 1, cost + costs.delete, audit + "D", kept, inserts)
        if kinds[i] not in (T.BLANK, T.DUPLICATE):
            extra = costs.truncated if kinds[i] == T.TRUNCATED else 0
            go(i + 1, cost + extra, audit + "K", kept + [(role, text)], inserts)
            for new in ("user", "assistant"):
                go(i + 1, cost + extra + costs.rerole, audit + "R", kept + [(new, text)], inserts)

    go(0, 0, "", [], inserts)
    return min(found, key=lambda x: (x[0], x[1]))


def run(rows, kinds, costs):
    c = T.Conversation(1, T.Steps(costs))
    for (turn, role, text), fault in reversed(list(zip(rows, kinds))):
        c.add(turn, role, text, "sua".find(role[:1] or "?") % 4 * 4 + fault)
    steps = list(T.edited(c.backlog))
    return c.cost + c.after[T.START], "".join(e for e, _, _ in steps), [(r, t) for _, r, t in steps if r is not None]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", " "]), st.sampled_from(["a.", "b!", "c", " ", "", "d? \n"])), max_size=3),
       st.sampled_from([T.Costs(), T.Costs(1, 9, 1, 0), T.Costs(7, 8, 2, 1), T.Costs(0, 0, 1, 0), T.Costs(3, 3, 3, 3)]))
def test_cheapest_edits(pairs, costs):
    rows = [(i, r, t) for i, (r, t) in enumerate(pairs)]
    kinds = faults(rows)
    assert run(rows, kinds, costs) == cheapest(rows, kinds, costs)


def plain(rows):
    """The audited row of one conversation's (turn, role, text) after damage."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    kinds = faults(rows)
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    # forward over all prefixes, keeping the least (cost, audit) for each state; inserts never pay at these costs
    best = {"": (0, "", ())}
    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for state, (cost, audit, kept) in best.items():
            ways = [(state, cost + 2, audit + "D", kept)]
            if kind in (T.FINE, T.TRUNCATED):
                extra = 5 * (kind == T.TRUNCATED)
                for letter, name, more in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if (state, name[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                        ways.append((name[:1], cost + extra + more, audit + letter, (*kept, f"{name}:{text}")))
            for s, *way in ways:
                if s not in new or tuple(way[:2]) < new[s][:2]:
                    new[s] = tuple(way)
        best = new
    cost, audit, kept = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    return (gaps, *(kinds.count(k) for k in (T.BLANK, T.DUPLICATE, T.TRUNCATED)), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def grouped(rows, convs):
    by = {c: [] for c in convs}
    for conv, *rest in rows:
        by[conv].append(tuple(rest))
    return by


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, cost int")


def corpus():
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(400)]
    rows += [(2, 5, "user", "same."), (2, 5, "user", "same."), (2, 5, "assistant", "other"), (2, None, "system", None), (2, None, None, "a!"), (2, 9, "user", ""), (2, 10, "", "x.")]
    rows += [(None, None, None, None), (None, 3, "user", "hi."), (None, 4, "assistant", "yes "), (4, None, "user", "q?"), (5, 1, "system", "s.")]
    rows += [(6, t, r, f"{'long text ' * 30_000}{t % 3}.") for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(7, 7, "assistant", "x."), (8, 1, "sys", "x."), (8, 2, "u", "\x0b\x0c.\t"), (8, 2**40, "a", "z!")]
    rows += [(c, t, ["user", "assistant", "system", "tool"][(c * 7 + t * t) % 4], f"{'w' * (c % 5)}{t % 6}{'.!?x '[(c + t) % 5]}") for c in range(20, 90) for t in range(c % 9)]
    return rows


@pytest.mark.parametrize("memory", [T.MEMORY, 200])
def test_audit_of_damaged(spark, monkeypatch, memory):
    monkeypatch.setattr(T, "MEMORY", memory)
    rows = corpus()
    got = {r.conv_id: tuple(r)[1:] for r in T.audit_damaged(table(spark, rows)).collect()}
    convs = {r[0] for r in rows}
    want = {c: plain(x) for c, x in grouped(damaged(rows), convs).items()}
    assert set(got) == set(want)
    assert {c: (got[c], want[c]) for c in convs if got[c] != want[c]} == {}


def test_repair(spark):
    rows = corpus()
    got = {}
    for r in sorted(T.repair(table(spark, rows)).collect(), key=lambda r: r.position):
        got.setdefault(r.conv_id, []).append((r.position, r.role, r.text, r.edit))
    audits = {r.conv_id: r for r in T.audit(table(spark, rows)).collect()}
    assert set(audits) == {r[0] for r in rows}
    for conv, r in audits.items():
        kept = got.get(conv, [])
        assert [p for p, *_ in kept] == list(range(len(kept))) and GOOD.fullmatch("".join(role[:1] for _, role, _, _ in kept))
        assert "".join(e for *_, e in kept) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text, _ in kept).encode()).hexdigest() == r.repaired_sha256


def test_empty_and_one_exchange(spark):
    empty = table(spark, corpus()).limit(0)
    assert T.audit_damaged(empty).count() == 0 and T.repair(empty).count() == 0
    plan = T.sorted_turns(table(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

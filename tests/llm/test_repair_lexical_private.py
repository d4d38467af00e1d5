"""Conversation repair, lexical search and personal data against brute force, with nulls, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from weftgraph.llm import lexical, private_data, repair

EDGE = {(0, 1): "s", (0, 2): "u", (1, 2): "u", (2, 3): "a", (3, 2): "u"}
NAME = {2: "user", 3: "assistant"}


def least_repair(rows):
    """Every edit of every row, and up to three insertions in each gap, keeping the cheapest and then least audit of each last role."""

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for q, (c, a, t) in list(out.items()):
                for n, name in NAME.items():
                    if (q, n) in EDGE and (n not in out or (c + 2, a + "I") < out[n][:2]):
                        out[n] = c + 2, a + "I", (*t, (name, ""))
        return out

    states = {0: (0, "", ())}
    for role, text, fault in rows:
        new = {}
        for q, (c, a, t) in inserted(states).items():
            found = [(q, (c + 3, a + "D", t))]
            if fault != "must":
                for (x, n), initial in EDGE.items():
                    if x == q and role[:1] == initial:
                        found.append((n, (c + fault, a + "K", (*t, (role, text)))))
                    elif x == q and n > 1:
                        found.append((n, (c + 2 + fault, a + "R", (*t, (NAME[n], text)))))
            for n, x in found:
                if n not in new or x[:2] < new[n][:2]:
                    new[n] = x
        states = new
    ends = inserted(states)
    return min((ends[q] for q in (0, 3) if q in ends), key=lambda x: x[:2])


def judged(rows):
    """The faults of one conversation's rows, in order, and its repair."""
    seen, out, counts, roles = set(), [], Counter(), [r for _, r, _ in rows]
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "must" if not body or (role, text) in seen else int(body[-1] not in ".!?")
        counts["blank" if not body else "duplicate" if (role, text) in seen else "truncated" if fault else "fine"] += 1
        seen.add((role, text))
        out.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, kept = least_repair(out)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": counts["blank"], "duplicate": counts["duplicate"], "truncated": counts["truncated"],
        "illegal": sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }, kept


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))


def conversations():
    r = random.Random(4)
    rows = []
    for conv in (*range(12), None):
        n = 300 if conv == 3 else r.randint(1, 9)
        for _ in range(n):
            rows.append((conv, r.choice([None, 1, 2, *range(n)]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "No", "So?", "a b. ", " \n", "", None, "ü!", "x" * r.randint(1, 3)])))
    return rows + [(5, 1, "user", "Same.")] * 40


def test_repair_equals_every_edit(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], "conv_id long, turn long, role string, text string, run string, present int")
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: judged(ordered(x)) for c, x in by.items()}
    got = {x.conv_id: {k: x[k] for k in want[x.conv_id][0]} for x in repair.repair_conversations(df, run_rows=7).collect()}
    assert got == {c: x[0] for c, x in want.items()}
    kept = defaultdict(list)
    for x in repair.repaired_turns(df, run_rows=7).orderBy("run", "place").collect():
        kept[x.conv_id].append((x.role, x.text))
    assert dict(kept) == {c: list(x[1]) for c, x in want.items() if x[1]}


def test_damage_and_dropped_conversations(spark):
    import zlib

    rows = [(c, t, "assistant", f"Turn {c} {t}.") for c in range(40) for t in (0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {c: [] for c in range(40)}
    for c, t, role, text in rows:
        case = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (t, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
        by[c] += [row] * (0 if case == 0 else 2 if case == 3 else 1)
    got = {x.conv_id: x for x in repair.repair_conversations(repair.damaged(df), "present").collect()}
    assert set(got) == set(by)
    for c, x in by.items():
        want = judged(ordered(x))[0]
        assert {k: got[c][k] for k in want} == want
    gone = spark.createDataFrame([(1, 1, "user", "x", False)], "conv_id long, turn long, role string, text string, present boolean")
    row = repair.repair_conversations(gone, "present").collect()[0]
    assert (row.gaps, row.cost, row.audit, row.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(df.limit(0)).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("shard_terms", [1, 60, 10**6])
def test_search_equals_scores_of_all(spark, shard_terms):
    r = random.Random(shard_terms)
    vocabulary = ["the", "of", "Übung", "word", *(f"t{i}" for i in range(60))]

    def text():
        return " ".join(vocabulary[min(int(r.expovariate(0.12)), len(vocabulary) - 1)] for _ in range(r.randint(0, 30)))

    docs = [(i, text()) for i in range(250)] + [(7, "the the word"), (None, "the word word"), (300, None), (301, "... -"), *[(400 + i, "same text t1") for i in range(40)]]
    items = [(i, text()) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "the the t1 same"), (None, "word")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id long").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    known = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n, total = len(known), sum(x[2] for x in known)
    df = Counter(t for _, c, _ in known for t in c)
    want = []
    for item, body in items:
        scored = []
        for doc, c, size in known:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(body) if t in c)
            if s > 0:
                scored.append((doc, s))
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        want += [(item, k + 1, doc, s) for k, (doc, s) in enumerate(scored[:20])]
    got = [tuple(x) for x in lexical.ranked_search(d, q, shard_terms=shard_terms).collect()]
    assert Counter(got) == Counter(want)


def test_search_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(d.limit(0), q).count() == 0
    assert lexical.ranked_search(d, q.limit(0)).count() == 0
    assert lexical.ranked_search(d, q.withColumn("text", q.text.substr(1, 0))).count() == 0


def test_search_stops_before_the_end():
    """Few high impacts decide: the groups below them are left, and the results are those of a whole pass."""
    import numpy as np

    n = 4000
    impacts = np.concatenate([[900_000] * 25, np.arange(n - 25, 0, -1)]).astype(np.int32)
    row = {
        "doc_id": list(range(n)), "terms": [b"x"], "ends": [n], "docs": np.arange(n, dtype=np.int32).tobytes(), "impacts": impacts.tobytes(),
        "by_doc": np.arange(n, dtype=np.int32).tobytes(), "places": np.arange(1, n + 1, dtype=np.int64).tobytes(),
    }
    shard = lexical._Shard(row)
    scored = []
    shard.whole = lambda docs, weights, whole=shard.whole: scored.append(len(docs)) or whole(docs, weights)
    found, scores = shard.best([(b"x", 3)], 20, 1)
    assert scored == [25] and set(scores.tolist()) == {2_700_000} and found.tolist() == list(range(25))
    assert not len(shard.best([(b"x", 3)], 20, 2_700_001)[0])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = [2 * int(x) - 9 * (x > "4") if i % 2 else int(x) for i, x in enumerate(digits[::-1])]
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and sum(checks) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    r, n = random.Random(9), 0
    for letters in ("a.@-b1", "12. -+()3", "+1 2.-(", "0123456789 -", "12.", "a@b.c@é1+ \n", "4 -1", "0.25"):
        for _ in range(6000):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 45)))
            want = base_spans(text)
            n += len(want)
            assert [x for x in private_data.private_spans(text) if x[0] in BASE] == want, text
    assert n > 3000


def test_spans_by_anchors_only():
    text = "at https://joe:pw@host.example/x, iban: DE89 3704 0044 0532 0130 00, IBAN DE89 3704 0044 0532 0130 01, account no. 12345678, discount 12345678 http://plain.example"
    found = [(k, text[a:b]) for k, a, b in private_data.private_spans(text) if k not in BASE]
    assert found == [("url", "https://joe:pw@host.example"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]


def test_private_data_of_odd_rows(spark):
    rows = [(1, "mail a@b.de", "x"), (1, "mail a@b.de", "x"), (2, None, None), (3, "", "y"), (None, "é 1.2.3.4 " + "w " * 200_000 + "+1 (386) 555-3733", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = private_data.private_data(df)
    got = {(x.doc_id, x.text): [tuple(s) for s in x.spans] for x in found.collect()}
    assert got == {(a, b): base_spans(b or "") for a, b, _ in rows} and found.count() == 5
    assert {x.text for x in private_data.redacted(found).collect()} == {"mail [email]", None, "", "é [ip] " + "w " * 200_000 + "[phone]"}
    assert private_data.private_data(df.limit(0)).count() == 0

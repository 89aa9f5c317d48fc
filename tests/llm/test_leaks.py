"""Leaked passages against a search for every run of words."""

import random

from strainspark.llm.leaks import banded_distance, find_leaks, gram_hashes, longest_run
from strainspark.llm.textnorm import words

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(1, 6))) for _ in range(40)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def brute(docs, items, least):
    out = {}
    for d, t in docs:
        for i, u in items:
            n = longest_run(words(t), words(u))
            if n >= least:
                out[d, i] = n
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r["n_words"] for r in find_leaks(d, i, **kw).collect()}


def test_against_brute_force(spark):
    items = [(i, text(40)) for i in range(6)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(40):
        body = text(30)
        if d % 2:
            u = words(items[d % 6][1])
            at, n = RNG.randrange(25), RNG.randrange(9, 16)
            body = f"{text(10)} {', '.join(u[at : at + n]).upper()} {body}"
        docs.append((d, body))
    docs += [(100, None), (101, ""), (102, "<p>" + items[0][1].replace(" ", "<br/>") + "</p>"), (103, text(3000) + " " + items[1][1] + " " + text(3000)), (104, items[2][1][:30]), (105, items[3][1] + " " + items[3][1])]
    want = brute(docs, [x for x in items if x[1]], 12)
    assert len(want) > 10
    assert found(spark, docs, items) == want


def test_encodings():
    assert words("Café (ABC-1) &eacute;té so­ft ze​ro <b>bo</b>ld ＦＵＬＬ") == words("café abc 1 ÉTÉ soft zero bold full")


def test_edits(spark):
    item = text(30)
    leaked = item[:70] + "#" + item[71:]
    docs = [(1, f"{text(5)} {leaked}"), (2, text(60))]
    assert (1, 7) in found(spark, docs, [(7, item)], max_edits=2)
    assert not any(d == 2 for d, _ in found(spark, docs, [(7, item)], max_edits=2))


def test_edits_near_the_ends_of_a_passage(spark):
    items = [(i, text(30)) for i in range(4)]
    docs = []
    for i, t in items:
        p = " ".join(words(t)[8:20])
        docs += [(10 * i + k, f"{text(6)} {p[:at]}{'q' if p[at] != 'q' else 'z'}{p[at + 1 :]} {text(6)}") for k, at in enumerate((0, 1, len(p) // 2, len(p) - 2, len(p) - 1))]
    got = found(spark, docs, items, max_edits=2)
    assert {k for k in got if k[0] // 10 == k[1]} == {(d, d // 10) for d, _ in docs}


def test_registered_leaks_allow_edits(spark, monkeypatch):
    from strainspark.llm import q_leaks

    item = text(14)
    w = words(item)
    tables = {"documents": spark.createDataFrame([(1, " ".join([*w[:6], w[6] + "x", *w[7:]]))], "doc_id bigint, text string"), "eval_items": spark.createDataFrame([(7, item)], "item_id bigint, text string")}
    monkeypatch.setattr(q_leaks, "table", lambda spark, d, name: tables[name])
    assert [(r["doc_id"], r["item_id"]) for r in q_leaks.p6_leaks(spark, "").collect()] == [(1, 7)]
    assert q_leaks.p6_items(spark, "").count() == 1 and q_leaks.p6_found(spark, "").count() == 0


def test_empty(spark):
    assert found(spark, [], [(1, text(20))]) == {} and found(spark, [(1, text(20))], []) == {}


def test_helpers():
    s = text(30)
    [(at, h)] = list(gram_hashes(s, 9))
    assert at == 0 and len(h) == len(s) - 8
    for a, b in ((0, 5), (3, 40)):
        assert (h[a] == h[b]) == (s[a : a + 9] == s[b : b + 9])
    [(_, again)] = list(gram_hashes("xyz" + s[10:30], 9))
    assert again[3] == h[10]
    assert banded_distance("abcdef", "xxabcxdefxx", 2, 2, 2) == 1 and banded_distance("abc", "zzzz", 0, 1, 1) == 2


def test_found_query_against_every_run_of_words(spark, data):
    from strainspark.llm.q_leaks import p6_found

    docs, items = (spark.read.parquet(f"{data}/{n}.parquet").collect() for n in ("documents", "eval_items"))
    runs = {}
    for r in items:
        w = words(r["text"])
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(r["item_id"])
    want = set()
    for r in docs:
        w = words(r["text"])
        want |= {(r["doc_id"], i) for k in range(len(w) - 11) for i in runs.get(tuple(w[k : k + 12]), ())}
    assert want and {(r["doc_id"], r["item_id"]) for r in p6_found(spark, data).collect()} == want


def test_exact_words_behind_an_edit(spark):
    item = text(40)
    w = words(item)
    docs = [(1, f"{text(4)} {' '.join(w[3:16])} {text(4)}"), (2, f"{text(4)} {' '.join([*w[3:9], w[9] + 'q', *w[10:16]])} {text(4)}")]
    rows = {r["doc_id"]: r for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string"), max_edits=1).collect()}
    assert rows[1]["n_exact"] >= 13 and rows[2]["n_exact"] == 0 and rows[2]["n_words"] >= 12


def test_an_item_of_short_words_leaves_the_others_as_they_are(spark):
    items = [(1, text(30)), (2, " ".join("abcdefghij"[k % 10] for k in range(14)))]
    docs = [(1, f"{text(5)} {items[0][1]}"), (2, f"zz {items[1][1]} zz"), (3, text(50))]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 2)} and set(found(spark, docs, items[:1])) == {(1, 1)}


def test_large_index_is_joined_by_a_shuffle(spark, monkeypatch):
    from strainspark.llm import leaks

    items = [(i, text(30)) for i in range(4)]
    docs = [(d, f"{text(9)} {items[d % 4][1]}") for d in range(8)]
    want = found(spark, docs, items)
    monkeypatch.setattr(leaks, "FEW", 0)
    assert found(spark, docs, items) == want and len(want) == 8


def test_many_alignments_at_once():
    from strainspark.llm.leaks import banded_distances

    def plain(p, t):
        """Least edits between p and any part of t."""
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    pairs = []
    for _ in range(60):
        p = "".join(RNG.choice("ab") for _ in range(RNG.randrange(1, 12)))
        pairs.append((p, "".join(RNG.choice("ab") for _ in range(RNG.randrange(0, 12))), 0))
    assert banded_distances(pairs, 30, 5).tolist() == [min(6, plain(p, t)) for p, t, _ in pairs]


def test_long_texts(spark):
    item = text(30)
    filler = text(4000)
    docs = [(1, f"{filler} {item} {filler}"), (2, filler)]
    assert set(found(spark, docs, [(7, item), (8, filler)], max_edits=1)) == {(1, 7), (1, 8), (2, 8)}

"""Ranked lexical search, personal data and clustering against brute force, with odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import annulus, personal, treaps
from corpusloom.llm.common import load

DATA = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(documents, items, k):
    """item -> [(doc_id, score)] by the definition."""
    held = [(d, Counter(plain_terms(t))) for d, t in documents if d is not None and plain_terms(t)]
    n, whole = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(plain_terms(t))
    out = {}
    for i, own in asked.items():
        found = []
        for d, c in held:
            m = 50 + 50 * c.total() * n // whole
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, d))
        if found:
            out[i] = [(d, -s) for s, d in sorted(found)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


def test_search_equals_the_definition_on_a_whole_table(spark):
    got = found(treaps.query(spark, DATA))
    documents, items = load(spark, DATA, "documents"), load(spark, DATA, "benchmark")
    assert got == ranked([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()], 50)


def test_search_on_odd_rows(spark):
    """Nulls, empty and long texts, copies, repeated ids, clashing columns; small shards, blocks of items, several k."""
    dice = np.random.default_rng(3)
    words = [f"w{k}" for k in range(30)] + ["Äpfel", "äpfel", "ΣΊΓΜΑ", "x1", "straße"]
    documents = [(k, " ".join(dice.choice(words, dice.integers(1, 40)).tolist()), k) for k in range(300)]
    documents += [(1000 + k, "w1 w2 w3, copy!", 0) for k in range(200)]
    documents += [(None, "w1 w1", 1), (2000, None, 1), (2001, "", 1), (2002, " .,;\n\x00", 1), (2003, "w5 " * 30000, 1), (2004, "x" * 70000 + " w6", 1), (7, documents[7][1], 2), (7, "w9 w9", 2)]
    items = [(1, "w1 W2 w3"), (2, None), (3, ""), (4, "äpfel Äpfel und STRASSE straße"), (5, "nothing here"), (None, "w1"), (6, "w6 w6 w6"), (6, "w7"), (7, " ".join(words)), (8, "w5"), (8, "w5")]
    table = spark.createDataFrame(documents, "doc_id long, text string, score long").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    plain = [(d, t) for d, t, _ in documents]
    for k, shard, size in ((50, 64, 1 << 20), (5, 10_000, 1 << 20), (300, 100, 40)):
        assert found(treaps.search(table, asked, k, shard, size)) == ranked(plain, items, k)
    for a, b in ((table.limit(0), asked), (table, asked.limit(0))):
        df = treaps.search(a, b)
        assert df.count() == 0 and df.columns == ["item_id", "rank", "doc_id", "score"]


def test_treaps_are_trees_by_document_and_heaps_by_impact():
    dice = np.random.default_rng(1)
    priority = dice.integers(0, 50, 400).tolist()
    starts = [0, 1, 150, 400]
    left, right, roots = treaps.grown(starts, priority)
    for at, end, root in zip(starts, starts[1:], roots.tolist(), strict=False):
        seen, path = [], [(root, at, end)]
        while path:
            node, low, high = path.pop()
            assert low <= node < high
            seen.append(node)
            for child, a, b in ((left[node], low, node), (right[node], node + 1, high)):
                if child >= 0:
                    assert priority[child] <= priority[node]
                    path.append((int(child), a, b))
        assert sorted(seen) == list(range(at, end))


def test_traversal_leaves_most_documents_out():
    """One rare term and a common one: few documents are scored."""
    dice, n = np.random.default_rng(2), 4000
    tf = [np.ones(n, np.int64), np.full(40, 3, np.int64)]
    place = np.concatenate([np.arange(n), np.sort(dice.choice(n, 40, replace=False))])
    term, impact = np.repeat([0, 1], [n, 40]), treaps.impacts(np.concatenate(tf), dice.integers(50, 400, n)[place], n, n * 200)
    left, right, roots = treaps.grown([0, n, n + 40], impact.tolist())
    arrays = {"documents": np.arange(n), "terms": np.array([0, 1]), "starts": np.array([0, n, n + 40]), "roots": roots, "place": place, "impact": impact, "left": left, "right": right}
    best = treaps.Best(10)
    scored = treaps.Shard({k: arrays[k].astype(kind).tobytes() for k, kind in treaps.INDEX.items()}).search(np.array([0, 1], np.int32), np.array([10, 5000]), best)
    whole = np.bincount(place, np.array([10, 5000])[term] * impact).astype(np.int64)
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == whole[order].tolist() and scored < n // 4


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(x := re.sub("[^0-9]", "", s)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(x[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def base(text):
    return [(k, *m.span()) for k, (pattern, good) in BASE.items() for m in re.finditer(pattern, text or "") if good(m[0])]


def test_personal_data_of_a_whole_table(spark):
    got = {r.doc_id: r for r in personal.query(spark, "/root/testdata/sf0.01").collect()}
    rows = load(spark, "/root/testdata/sf0.01", "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = base(r.text)
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[r.doc_id].spans.startswith(text)
        assert got[r.doc_id].spans == text  # nothing else is planted there


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1289.@-+ ()%é\n", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert [s[:3] for s in personal.spans(text) if s[0] in personal.BASE] == base(text)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00", "iban"),
        ("GB82WEST12345698765432 is theirs", "iban"),
        ("his SSN is 536-22-8417.", "ssn"),
        ("ABA routing number 021000021", "routing"),
        ("card 378282246310005", "shortcard"),
    ],
)
def test_added_kinds(text, kind):
    found = [s for s in personal.spans(text) if s[0] == kind]
    assert len(found) == 1 and found[0][3] >= personal.THRESHOLD
    assert f"[{kind}]" in personal.masked(text)


@pytest.mark.parametrize("text", ["DE89 3704 0044 0532 0130 01", "part 536-22-8417 of the list", "number 021000021", "378282246310005", "SSN 000-12-3456", "ABA 021000022", "no data here", "x +1 (536) 22-8417-11"])
def test_added_kinds_need_their_checksum_or_a_word_nearby(text):
    assert not [s for s in personal.spans(text) if s[0] in personal.ADDED]


def test_words_nearby_raise_scores():
    far, near = (personal.spans(t)[0][3] for t in ("it says +1 (212) 555-0100 there", "phone: +1 (212) 555-0100"))
    assert near > far


def test_personal_data_on_odd_rows(spark):
    texts = [None, "", "x" * 60000, "1" * 60000, "1." * 30000, "+1" + "(" * 60000, "a@" * 30000, "@", "1 " * 30000, "a@b.c@d.e", "é a@b.co ü 1.2.3.4"]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "a@b.co", 2), (9, texts[9], 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = personal.digest(table).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.spans) for r in got) == sorted((d if d is not None else -1, ",".join(f"{k}:{s}:{e}" for k, s, e in base(t))) for d, t, _ in rows)
    assert personal.digest(table.limit(0)).count() == 0
    held = {r.doc_id: r.spans for r in personal.scan(table).collect()}
    assert [(s.kind, s.start, s.end) for s in held[10]] == [("email", 2, 8), ("ip", 11, 18)]
    assert personal.masked("mail a@b.co or 1.2.3.4") == "mail [email] or [ip]" and personal.masked(None) is None


def clustered(rows, k, rounds, seed=2):
    """vec_id -> (cluster, distance) multiset, centroids; by comparing all pairs."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    own = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(own)) for _, v in kept]
        if turn == rounds:
            return sorted((i, j, d) for (i, _), (d, j) in zip(kept, near, strict=True)), own
        for j in range(len(own)):
            mine = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
            if mine:
                own[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]


def test_clusters_equal_brute_force_on_odd_rows(spark):
    dice = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in dice.normal(size=64) * (1 + k % 7)]) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(20)] + [(3, rows[3][1]), (3, rows[5][1]), (300, [0.0] * 64), (301, [float(k % 2) for k in range(64)]), (302, [-float(k % 2) for k in range(64)])]
    odd = [(None, [1.0] * 64), (400, None), (401, []), (402, [1.0] * 63), (403, [float("nan")] * 64), (404, [float("-inf")] * 64), (405, [None] * 64)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    for k, rounds in ((40, 5), (3, 2), (500, 1)):
        want, own = clustered(rows, k, rounds)
        got = annulus.cluster(table, k, rounds).collect()
        assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want
        inertia = Counter()
        for _, j, d in want:
            inertia[j] += d
        for r in got:
            assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], inertia.total())
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, own[r.cluster])).encode()).hexdigest()
    assert annulus.cluster(table.limit(0)).count() == 0 and annulus.cluster(table.filter("vec_id >= 400")).count() == 0


def test_rings_hold_the_nearest_and_leave_others_out():
    """Ties on the ring's edge too; norms far apart leave most centroids out; large components are exact."""
    dice = np.random.default_rng(6)
    own = np.concatenate([np.outer(np.arange(1, 31) * 40, dice.integers(0, 9, 64)), np.zeros((1, 64), int), np.zeros((1, 64), int)]).astype(np.int64)
    x = np.concatenate([own[3:25] + dice.integers(-5, 6, (22, 64)), own[:2], -own[:1], np.zeros((2, 64), np.int64)])
    number, squared, taken = annulus.Rings(own).nearest(x)
    whole = ((x[:, None] - own[None]) ** 2).sum(2)
    assert number.tolist() == whole.argmin(1).tolist() and squared.tolist() == whole.min(1).tolist() and taken < whole.size // 3
    big = own * 4000
    number, squared, _ = annulus.Rings(big).nearest(x * 4000 + 1)
    whole = ((x[:, None] * 4000 + 1 - big[None]) ** 2).sum(2)
    assert number.tolist() == whole.argmin(1).tolist() and squared.tolist() == whole.min(1).tolist()


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        annulus.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()

"""Filter audit, clustering and substring deduplication against plain computations, with their edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = re.compile("[^\x20\x09-\x0d]+")


def test_filter_audit_against_plain_counts(spark, documents):
    from framelake.llm.audit import interactions

    draw = random.Random(4)
    some = [" ".join(draw.choice(["a", "B", "cc", "DD", "x$", "é"]) for _ in range(draw.choice([0, 3, 150, 199, 200, 260]))) for _ in range(12)]
    some += [" ".join(f"w{i}{k}" for i in range(220)) for k in range(4)] + ["A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "  \n", ""]
    rows = [(i, draw.choice(some), draw.choice(["en", "fr", None, ""])) for i in range(150)] + [(150, None, "de"), (3, some[0], "en"), (3, some[0], "en"), (None, some[0], "en"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, p, "clash") for i, t, p in rows], "doc_id long, text string, lang string, left string")
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 150, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    facts = []
    for i, t, p in rows:
        t = t or ""
        words = WORDS.findall(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        mine = [x for x in labels if i is not None and x[0] == i]
        facts.append((p or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for *_, x in mine)))
    expected = {}
    for part in {f[0] for f in facts}:
        own, total = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, c in enumerate(order, 1):
                gone, was, alive = [f for f in alive if f[1][c]], len(alive), [f for f in alive if not f[1][c]]
                failing = [f for f in own if f[1][c]]
                total[c] += len(gone)
                only = sum(sum(f[1].values()) == 1 for f in failing)
                assert was == len(gone) + len(alive)
                expected[part, "".join(order), step] = [len(alive), len(gone), len(failing) - len(gone), only, sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in expected.items():
            if p == part:
                row.append(total[order[step - 1]])
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in interactions(docs.repartition(5), marks).collect()}
    assert got == expected and len(got) == 600 * 5 - 600  # null and empty languages are one part
    assert interactions(docs.limit(0), marks).count() == 0 and interactions(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_bitmaps_of_many_parts():
    from framelake.llm.audit import popcounts

    draw = np.random.default_rng(2)
    parts, fails, mark = draw.integers(0, 300, 2000).astype(str).astype(object), draw.integers(0, 8, 2000), draw.random(2000) < 0.3
    names, counts = popcounts(parts, fails, [mark], 3)
    for k, name in enumerate(names):
        for some in range(8):
            left = (parts == name) & (fails & some == 0)
            assert counts[k, some].tolist() == [left.sum(), (left & mark).sum()]


def plain_clusters(v, first, rounds):
    c = v[first].copy()
    nearest = lambda: ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)
    for _ in range(rounds):
        own = nearest()
        c = np.array([[int(x) // int((own == j).sum()) for x in v[own == j].sum(0)] if (own == j).any() else c[j] for j in range(len(c))])
    return nearest(), c


def test_clusters_against_plain_rounds(spark):
    from framelake.llm.clusters import clustered

    draw = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in draw.integers(-3, 4, 64) / 1024 * draw.choice([1, 200])]) for i in range(300)]
    rows += [(i + 300, rows[i % 7][1]) for i in range(100)]  # repeated vectors: equal distances
    good = len(rows)
    bad = [(900, [0.0] * 63), (901, None), (902, [0.0] * 63 + [None]), (903, [float("nan")] + [0.0] * 63), (904, [float("-inf")] + [0.0] * 63), (905, []), (906, [1e30] + [0.0] * 63)]
    frame = spark.createDataFrame([(i, e, 1) for i, e in rows + bad + [(None, rows[0][1])]], "vec_id long, embedding array<double>, cluster int")
    got = clustered(frame.repartition(3)).collect()
    v = np.array([np.floor(1024 * np.array(e)) for _, e in rows + [(None, rows[0][1])]]).astype(np.int64)
    first = sorted(range(good), key=lambda i: hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest())[:8]
    own, c = plain_clusters(v, first, 10)
    d = ((v - c[own]) ** 2).sum(1)
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    expected = [(i, int(own[k]), int(d[k]), int(d[own == own[k]].sum()), int(d.sum()), names[own[k]]) for k, (i, _) in enumerate(rows + [(None, None)])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert clustered(frame.limit(0)).count() == 0 and clustered(frame.where("vec_id is null")).count() == 0
    few = clustered(frame.where("vec_id < 3")).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_exponion_keeps_ties_and_scans_less():
    from framelake.llm.clusters import Centroids

    draw = np.random.default_rng(3)
    centres = draw.integers(-400, 400, (40, 6)) * 10
    v = np.concatenate([(centres[draw.integers(0, 40, 4000)] + draw.integers(-30, 31, (4000, 6))), np.repeat(centres, 2, 0)]).astype(np.int64)
    c, before = np.concatenate([centres[:20] + 5, centres[:20] + 5, centres[20:]]).astype(np.int64), None  # pairs of equal centroids
    own, upper, lower, scanned = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros(len(v)), []
    for _ in range(12):
        own, upper, lower, n = Centroids(c, before).assign(v, own, upper, lower)
        apart = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (own == apart.argmin(1)).all()
        scanned.append(n)
        before, c = c, np.array([v[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(len(c))])
    assert scanned[-1] < len(v) * len(c) / 20


def plain_substrings(rows, window):
    starts, out = {}, []
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                starts[key] = min(starts.get(key, i), i)
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and starts[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    return out


def passages(draw, n):
    word = lambda: draw.choice(["alpha", "be", "γ", "delta", "Ep", "z,"]) + str(draw.randrange(6))
    shared = [[word() for _ in range(draw.randint(20, 130))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += draw.choice(shared)[draw.randrange(12) :] if draw.random() < 0.6 else [word() for _ in range(draw.randint(0, 90))]
        rows.append((i, draw.choice([" ", "\n", "  \t"]).join(words)))
    return rows


@pytest.mark.parametrize("window", [50, 7, 2])
def test_substrings_against_all_windows(spark, documents, window):
    from framelake.llm.substrings import deduplicated, removed_words, repeated_spans

    draw = random.Random(window)
    rows = passages(draw, 120)
    rows += [(130, None), (131, ""), (132, " \n"), (133, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (140, rows[7][1].replace(" ", "\n")), (-1, rows[8][1] + " end"), (141, "la " * 400), (142, "la " * 300)]
    found = repeated_spans(documents(*rows).repartition(4), window)
    got = [tuple(r) for r in found.select("doc_id", "n_words", removed_words(), "kept_sha256").collect()]
    expected = plain_substrings(rows, window)
    assert sorted(map(str, got)) == sorted(map(str, expected)) and sum(r[2] > 0 for r in expected) > 20
    cut = [(r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in deduplicated(documents(*rows), window).collect()]
    assert sorted(map(str, cut)) == sorted(str((r[0], r[3])) for r in expected)
    assert repeated_spans(documents(*rows).limit(0), window).count() == 0


def test_cover_meets_every_shift():
    from framelake.llm.substrings import COVERS, anchor_hashes, cover

    for period, places in COVERS.items():
        assert {(a - b) % period for a in places for b in places} == set(range(period))
    for window in (1, 2, 5, 10, 50, 200):
        period, _, size = cover(window)
        assert size >= 1 and period - 1 + size == window
    import pyarrow as pa

    assert anchor_hashes(pa.array(["a b", None, ""]), 50)[2].size == 0


def test_look_up_of_hot_and_null_keys(spark):
    from framelake.llm.common import looked_up

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id")).alias("key"), "id")
    table = rows.groupBy("key").agg(F.max("id").alias("most"), F.count("*").alias("n")).where("key is not null and key <> 5")
    got = {r["id"]: r["most"] for r in looked_up(rows, table, "key").collect()}
    assert len(got) == 5000 and all(got[i] == (None if i % 3 == 0 or i == 5 else 4999 if i % 3 == 1 else i) for i in got)

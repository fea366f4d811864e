"""SimHash classes, the Gray-order index and near copies, against plain versions."""

import collections
import random

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash


def plain_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, radius):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    out = [None, "", " \t\n", "One", "one", "A b C", "\x0bx\x0c", "é É"]
    for t in base:
        w = t.split()
        out += [t, t.upper()]
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out + ["long " * 30000]


@pytest.mark.parametrize("limit", [simhash.ROUTE_LIMIT, 2])
def test_classes(spark, limit):
    rows = [(i, t, "x", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id bigint").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicate_classes(df, limit=limit).collect()}
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{p:016x}" for p in prints]
    assert {i: got[i].component_id for i in got} == plain_components(prints, [r[0] for r in rows], 2)


def test_empty_table_repeats_and_null_ids(spark):
    schema = "doc_id bigint, text string"
    assert simhash.near_duplicate_classes(spark.createDataFrame([], schema)).count() == 0
    got = simhash.near_duplicate_classes(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "z")], schema)).collect()
    assert sorted(str(r.component_id) for r in got) == ["5", "5", "5", "None"]


def test_gray_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) & np.uint64(0xFFFF0000FFF))
    rank = rows.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    rows = rows[np.argsort(rank)][:, None]
    q, r = simhash.GrayIndex(rows).search(rows, 3)
    plain = {(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(rows[:, 0] ^ rows[i, 0]) <= 3).tolist()}
    assert set(zip(q.tolist(), r.tolist())) == plain


def test_routes_meet_within_the_radius():
    rng = random.Random(3)
    tree = simhash.route_tree(2)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        level = [0]
        for step in tree:  # at every depth some mask that extends a shared one is shared
            level = [m for up in level for m in step[up] if a & m == b & m]
            assert level


def test_near_copies_keep_one_of_each_group(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(30):
        base = [rng.choice(words) for _ in range(200)]
        for k in range(4 if g else 60):
            w = list(base)
            for _ in range(0 if k == 0 else 2):
                w[rng.randrange(200)] = rng.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w), "s"))
    rows += [(len(rows), None, "s"), (len(rows) + 1, "", "s"), (None, "null id", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lead string").repartition(4)
    kept = [r.doc_id for r in simhash.drop_near_copies(df).collect()]
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t, _ in rows[:-3]}
    near = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8
    counts = collections.Counter(group[i] for i in kept if i in group)
    assert set(counts) == set(range(30))  # no group is lost
    left = [i for i in kept if i in group]
    missed = sum(near(a, b) for a in left for b in left if a < b)
    assert missed <= 2 and None in kept and len(rows) - 3 in kept and len(rows) - 2 not in kept


def template_pages(pages, copies, rng):
    """Pages of one template, about 0.72 alike, and planted copies of some that are about 0.85 alike."""
    words = [f"word{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    own = [base + [f"own{p}x{i}" for i in range(22)] for p in range(pages)]
    planted = [w[:-k] + [f"copy{p}x{i}" for i in range(k)] for p, w in enumerate(own[:copies]) for k in (10 + p % 2,)]
    return [" ".join(w) for w in own + planted]


def test_copies_inside_a_large_family_of_template_pages(spark):
    pages, copies = 3000, 150
    rows = list(enumerate(template_pages(pages, copies, random.Random(8))))
    runs = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    alike = lambda a, b: len(runs[a] & runs[b]) / len(runs[a] | runs[b])
    assert all(alike(p, pages + p) >= 0.8 for p in range(copies))
    assert max(alike(0, p) for p in range(1, 50)) < 0.75
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    left = [p for p in range(copies) if pages + p in kept]
    assert set(range(pages)) <= kept  # no page goes for a page that is less than 0.8 alike
    assert len(left) <= 0.02 * copies, len(left)


def test_a_large_loose_family_keeps_all_its_links(spark, monkeypatch):
    """Against all pairs: pages of one template that drift, so that some pairs reach the similarity and most don't."""
    monkeypatch.setattr(simhash, "UNIT_ROWS", 100)  # many units to a route
    monkeypatch.setattr(simhash, "TIE_ROWS", 300)
    rng = random.Random(12)
    words = [f"word{i}" for i in range(4000)]
    page, rows = [rng.choice(words) for _ in range(150)], []
    for i in range(1200):
        w = list(page)
        for at in rng.sample(range(150), rng.choice([2, 4, 6, 8])):
            w[at] = f"own{i}x{at}"
        rows.append((i, " ".join(w)))
    runs = [{tuple(t.split()[j : j + 5]) for j in range(146)} for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = find(a), find(b)
            if x != y and len(runs[a] & runs[b]) / len(runs[a] | runs[b]) >= 0.8:
                root[max(x, y)] = min(x, y)
    want = {i for i in range(len(rows)) if find(i) == i}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, same string, hub int").repartition(6)
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert want <= kept and len(kept) <= len(want) + 0.01 * len(rows), (len(kept), len(want))


def test_band_keys_meet_as_often_as_the_similarity_says():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        common, own = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)
        a, b = np.concatenate([common, own[:20]]), np.concatenate([common, own[20:]])
        keys = simhash.band_keys(np.concatenate([a, b]), np.array([180, 180]))
        met += bool((keys[0] == keys[1]).any())
    assert met >= 0.96 * 300 and simhash.band_keys(np.empty(0, np.uint64), np.array([0, 0])).shape == (0, simhash.BANDS)


def test_an_id_on_two_texts_loses_no_text(spark):
    a, b = "one two three four five six seven", "red orange yellow green blue indigo violet"
    rows = [(3, b), (5, a), (5, b), (7, a), (9, None), (9, a.upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.text) for r in simhash.drop_near_copies(df).collect()}
    assert got == {(3, b), (5, a), (9, None)}

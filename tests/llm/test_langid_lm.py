"""Language identification and the Kneser-Ney model."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from cairn.llm import langid, lm

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "eit", "ung", "ver"], "cc": ["ción", "mente", "ado", "ía"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang))
    return out


def test_languages(spark):
    rows = corpus()
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "12 !? 34", "bb"), (903, "KALOMI TU", None), (904, "日本", "aa"), (905, "ka " * 50_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id bigint, text string, lang string, lang_pred string").repartition(3)
    train = df.where(langid.hash_remainder("doc_id", 3) != 1)
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(train)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and got[904].lang_pred in SYLLABLES and got[905].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in langid.keep_identified(df).collect()}
    assert kept >= {r[0] for r in rows} and not kept & {900, 901, 902}
    none = langid.identify(df, langid.fit(df.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"} and langid.identify(df.limit(0), langid.fit(train)).count() == 0


def test_gibberish_and_unlabelled_languages_go(spark):
    rng = random.Random(5)
    letters = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9)))
    rows = [*corpus(), *[(1000 + i, " ".join(letters() for _ in range(60)), None) for i in range(20)], (1100, "Все люди рождаются свободными и равными " * 3, None)]
    rows += [(1200, rows[0][1], None), (1200, rows[0][1], None), (None, rows[0][1], "aa"), (1201, "kalo", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, score int").repartition(3)
    out = langid.keep_identified(df)
    kept = out.collect()
    assert out.schema == df.schema and {r.doc_id for r in kept} == {r[0] for r in corpus()} | {1200, None, 1201}
    assert sum(r.doc_id == 1200 for r in kept) == 2
    assert {r.lang for r in kept if r.doc_id == 1200} == {rows[0][2]}  # a null language is filled
    assert langid.keep_identified(df.limit(0)).count() == 0


def test_masks_hold_all_languages_of_a_gram():
    grams = {"a": np.arange(1, 500, dtype=np.uint64), "b": np.arange(400, 900, dtype=np.uint64)}
    f = langid.LanguageFilters.build(grams, "a")
    m = f.masks(np.array([10, 450, 800], dtype=np.uint64))[:, 0].tolist()
    assert m == [1, 3, 2] and (f.false_rate < 0.01).all()


def plain_model(train):
    pairs, counts = collections.Counter(), collections.Counter()
    for t in train:
        counts.update(t)
        pairs.update(zip(["S", *t[:-1]], t))
    number = lambda c, k: sum(1 for x in c.values() if x == k)
    d = lm.discounts([number(pairs, k) for k in (1, 2, 3, 4)])
    before = collections.Counter(w for _, w in pairs)
    e = lm.discounts([number(before, k) for k in (1, 2, 3, 4)])
    follow = collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), x in pairs.items():
        follow[v][min(x, 3) - 1] += 1
    n1, n2 = number(before, 1), number(before, 2)
    spare = (e[1] * n1 + e[2] * n2 + e[3] * (len(before) - n1 - n2)) / len(pairs)

    def p(v, w):
        low = max(before[w] - e[min(before[w], 3)], 0) / len(pairs) + spare / (len(counts) + 1)
        seen = len(train) if v == "S" else counts[v]
        if not seen:
            return low
        x = pairs[v, w]
        return max(x - d[min(x, 3)], 0) / seen + (d[1] * follow[v][0] + d[2] * follow[v][1] + d[3] * follow[v][2]) / seen * low

    return p, counts


@pytest.mark.parametrize("part_bytes, coarse", [(lm.PART_BYTES, lm.COARSE), (300, lm.COARSE), (300, 5)])
def test_kneser_ney_equals_a_plain_model(spark, monkeypatch, part_bytes, coarse):
    monkeypatch.setattr(lm, "PART_BYTES", part_bytes)
    monkeypatch.setattr(lm, "COARSE", coarse)  # fewer than the partitions: a second exchange divides them
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(vocabulary[min(int(rng.expovariate(0.12)), 39)] for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "", "Ünseen\x0bWORD w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    split = lambda t: [*(t or "").encode().lower().split(), "END"]
    p, counts = plain_model([split(t) for t in texts[:120]])
    got = {r.doc_id: r for r in lm.score(df, lm.fit(df.where("doc_id < 120"))).collect()}
    total = sum(counts.values())
    for i, t in enumerate(texts):
        w = split(t)
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(counts[x] > 0 for x in w) and got[i].train_tokens == total
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w))
        assert got[i].score == pytest.approx(sum(math.log10(p(v, x)) for v, x in zip(["S", *w[:-1]], w)), rel=1e-6)
    assert sum(p(b"w1", x) for x in counts) + p(b"w1", "new") == pytest.approx(1)


def test_untrained_model(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.score(df, lm.fit(df.limit(0))).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and math.isfinite(got[1].score) and got[2].n_tokens == 1
    assert lm.score(df.limit(0), lm.fit(df)).count() == 0


def test_repeated_rows_null_ids_and_a_very_long_text(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b"), (2, "a b " * 200_000)]
    df = spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id bigint, text string, score double, n_tokens int")
    got = sorted(((str(r.doc_id), r.n_tokens, r.train_tokens) for r in lm.score(df, lm.fit(df)).collect()))
    assert got == [("1", 4, 400012), ("1", 4, 400012), ("2", 400001, 400012), ("None", 3, 400012)]


def test_pairs_that_share_48_bits_are_told_apart(tmp_path, monkeypatch):
    v, w = np.arange(1, 9, dtype=np.uint64), np.arange(11, 19, dtype=np.uint64)
    g = np.uint64(5) << np.uint64(48) | np.arange(8, dtype=np.uint64)  # only the lowest bits differ
    monkeypatch.setattr(lm, "pair_hash", lambda v, w: np.uint64(5) << np.uint64(48) | (v - np.uint64(1)))
    top = (g >> np.uint64(64 - lm.DIRECTORY_BITS)).astype(np.int64)
    directory = np.searchsorted(top, np.arange((1 << lm.DIRECTORY_BITS) + 1)).astype(np.int64)
    kept = np.array([0, 2, 4, 6])
    counts = np.array([1, 2, 3, 2**33], np.int64)
    directory = np.searchsorted(top[kept], np.arange((1 << lm.DIRECTORY_BITS) + 1)).astype(np.int64)
    lm.write_arrays(f"file://{tmp_path}", lm.pair_file(0), [np.array([4, 8], np.int64), directory, *lm.halves(g[kept]), counts])
    model = lm.Model(f"file://{tmp_path}", 1, np.empty(0, np.uint64), 1, 1, 1, 4, np.zeros(4), np.zeros(4), np.zeros(3))
    assert model.pair_counts(v, w).tolist() == [1, 0, 2, 0, 3, 0, 2**33, 0]


def test_packing_round_trips():
    v, w, c = lm.summed(np.array([3, 3, 9, 3], np.uint64), np.array([1, 1, 2, 7], np.uint64), np.array([1, 400, 1, 2]))
    assert all((a == b).all() for a, b in zip(lm.unpack(lm.pack(v, w, c)), (v, w, c)))
    h, columns = np.array([5, 8], np.uint64), np.array([[1, 2], [300, 4], [0, 0], [1, 1], [9, 9]])
    got = lm.unpack_words(lm.pack_words(h, columns))
    assert (got[0] == h).all() and (got[1] == columns).all()

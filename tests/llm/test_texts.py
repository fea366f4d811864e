"""Personal data, pages, tokens, benchmark items and repeated strings, against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from cairn.llm import bpe, decontamination, html, pii, suffixdedup


# Personal data


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for k in range(20_000):
        t = "".join(rng.choice("0123456789.@+-() aé_,\n" if k % 2 else "0123456789 -.@a") for _ in range(rng.randint(1, 60)))
        assert pii._joined(pii.base_spans(t), pii.BASE) == ",".join("{}:{}:{}".format(*x) for x in plain_base(t))
    assert list(pii.cards("4111-1111 1111 1111, 4111111111111112")) == [(0, 19)]
    long = "1" * 50_000 + ".2.3.4 " + "a" * 50_000 + "@"
    assert sum(map(len, pii.base_spans(long).values())) == 0


def test_weak_supervision(spark):
    noise = [(i, f"order 000-12-{1000 + i} shipped") for i in range(40)]
    good = [(100 + i, f'the ssn 123-45-{6000 + i} and token = "a1b2c3d4e5f6{i:03d}" call (415) 555-{2000 + i} now') for i in range(60)]
    rows = [*noise, *good, (200, None), (201, ""), (202, "mail a@b.co " * 5000)]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id bigint, text string, spans string, n_chars int").repartition(3)
    model = pii.fit(df)
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    assert all(k in got[100 + i].spans for i in range(60) for k in ("secret:", "nationalid:", "contact:"))
    assert not any(got[i].spans for i in range(40))  # numbers that no rule allows
    assert got[200].spans == got[201].spans == "" and got[202].n_email == 5000
    assert all(got[i].base == ",".join("{}:{}:{}".format(*x) for x in plain_base(t or "")) for i, t in rows)
    masked = {r.doc_id: r for r in pii.mask(df).collect()}
    assert masked[200].text is None and masked[202].text == "mail [EMAIL] " * 5000 and masked[202].n_chars == len(masked[202].text)
    assert "[SECRET]" in masked[100].text and masked[0].text == noise[0][1]
    assert pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0


def test_a_long_secret_is_proposed_whole():
    value = "a1B2" * 90
    for text in (f"token = {value} end", f'token = "{value}" end'):
        at = text.index(value)
        assert list(pii.proposals(text, pii.base_spans(text))) == [("secret", at, at + len(value))]


def test_em_tells_labelers_apart():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.6)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    right, _ = pii.em(patterns, counts.astype(float))
    assert right[0] > right[1] > right[2] and abs(right[2] - 0.6) < 0.08


# Pages


def test_layout():
    page = """<html><head><title>no</title><style>.ad, #x{display:none}</style></head><body><div class="big ad">no</div><i id=x>no</i>
    <p>One<b>two</b><br>three<p>Four <ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li value=9>y<li>z</ol>
    <table><caption>cap</caption><tr><th>Name<th>Age<tr><td>Bob<td>5<tr><td>Christopher<td>77</table><pre>  a\n    b</pre>
    <span hidden>no</span><template>no</template><div style="DISPLAY : none">no</div>tail &amp; end<script>var t="</p>";</script>"""
    assert html.visible_text(page) == "Onetwo\nthree\n\nFour\n\n- a\n- b\n  - c\n\n3. x\n9. y\n10. z\n\ncap\nName         Age\nBob          5\nChristopher  77\n\n  a\n    b\n\ntail & end"


def test_all_visible_words_stay_in_order():
    rng = random.Random(7)
    tags = ["p", "div", "b", "li", "ul", "td", "tr", "table", "h2", "span", "blockquote", "dd", "pre"]
    for _ in range(200):
        out, words = [], []
        for k in range(40):
            kind = rng.randrange(3)
            if kind == 0:
                out.append(f"<{rng.choice(tags)}>")
            elif kind == 1:
                out.append(f"</{rng.choice(tags)}>")
            else:
                words.append(f"w{k}")
                out.append(f" w{k} ")
        assert sorted(html.visible_text("".join(out)).replace("-", " ").split()) == sorted(words)


def test_pages_table(spark):
    deep = "<div>" * 30_000 + "deep" + "</div>" * 30_000
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, deep, "t"), (4, "a<b <", "t"), (4, "a<b <", "t")], "page_id bigint, html string, text string")
    got = sorted((r.page_id, r.text) for r in html.extract(df).collect())
    assert got[0] == (1, "") and got[1] == (2, "") and got[2] == (3, "deep") and len(got) == 5 and html.extract(df.limit(0)).count() == 0


# Tokens


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_tokens_equal_the_library(spark, tokenizer):
    path, library = tokenizer
    tables = bpe.load(path)
    rng = random.Random(5)
    marks = ["a", "B", "é", "日", " ", "  ", "\n", "'s", "'LL", "1", "٣", "<|endoftext|>", "<|endof", " ", "　", "_", "👍🏽", "​", "aaaa", "\r\n", "!?"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "a" * 20_000, " " * 5000]
    encoder = bpe.Encoder(tables)
    ids, counts = encoder.encode([*texts, None])
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for t, own, text, ref in zip(texts, parts, tables.decode(ids, counts), library.encode_batch(texts, add_special_tokens=False)):
        assert own.tolist() == ref.ids and text == library.decode(ref.ids, skip_special_tokens=False) == t
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts[:50], None])], "doc_id bigint, text string, ids string")
    coded = bpe.encode(df, tables)
    assert {r.doc_id: r.text for r in bpe.decode(coded, tables).collect()} == dict(enumerate([*texts[:50], ""]))
    assert bpe.encode(df.limit(0), tables).count() == 0


def test_cache_starts_anew_and_broken_bytes_decode(tokenizer, monkeypatch):
    path, library = tokenizer
    tables = bpe.load(path)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "MERGE_BYTES", 8)
    encoder = bpe.Encoder(tables)
    for _ in range(3):
        for t in ("some words that fill it", "and more of them", "<|endoftext|>"):
            assert encoder.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
    half = [library.encode("日", add_special_tokens=False).ids[0]]
    assert tables.decode(np.array(half), np.array([1])) == [library.decode(half, skip_special_tokens=False)]


# Benchmark items


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_leaks_within_the_distance(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 45))) for _ in range(60)]
    texts, truth = [], []
    for k, item in enumerate(items):
        w = item.split()
        for _ in range(rng.randint(0, decontamination.allowed(len(w), 0.8))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 2 else ["zzz"]
        texts.append(" ".join(["Q,", *[rng.choice(words) for _ in range(30)], *w, *[rng.choice(words) for _ in range(30)]]))
        truth.append((k, k))
    texts += [" ".join(rng.choice(words) for _ in range(300)) for _ in range(60)] + [None, "", items[0].upper(), "w1 " * 30_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([*enumerate(items), (900, None), (901, ""), (902, "?!")], "item_id bigint, text string")
    got = decontamination.leaks(df, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & set(truth)) >= 0.97 * len(truth) and (122, 0) in found
    for r in got:
        window = decontamination.words_of(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        item = decontamination.words_of(items[r.item_id])
        assert distance(window, item) == r.distance <= decontamination.allowed(len(item), 0.8) and r.similarity >= 0.8
    kept = {r.doc_id for r in decontamination.drop_leaks(df, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in found} and {120, 121, 123} <= kept
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.leaks(df.limit(0), bench).count() == 0


def test_short_items_and_unspaced_scripts_match_exactly(spark):
    items = [(1, "What is 2 + 2?"), (2, "Zanzibar"), (3, "水は何度で沸騰しますか"), (4, "one two")]
    texts = ["So, what is 2+2? he said", "what is two and 2", "off to ZANZIBAR!", "先生は「水は何度で沸騰しますか」と聞いた", "水は何度で", "two one", "one, two", None]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[6])], "doc_id bigint, text string")
    got = decontamination.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("0", 1), ("0", 1), ("2", 2), ("3", 3), ("6", 4), ("None", 4)]


def test_windows_are_verified_where_repetitions_run_out(monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(100)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)]
    texts = []
    for _, t in items:
        w = t.split()
        for at in (2, 9, 15, 20, 25, 28):
            w[at] = "zzz"
        texts.append("before it " + " ".join(w) + " after it")
    monkeypatch.setattr(decontamination, "MAX_REPETITIONS", 1)
    index = decontamination.BenchmarkIndex(items)
    assert index.sizes[0].exhaustive
    found = {(t, k): (p, d) for t, k, p, _, d in index.find(texts)}
    assert all(found[k, k] == (2, 6) for k in range(20))


def test_the_index_grows_with_its_items_alone():
    import pickle

    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(rng.randint(20, 60)))) for i in range(1500)]
    text = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontamination.BenchmarkIndex(items))) < 30 * text


def test_blocks_of_items_find_the_same(spark):
    items = [(i, f"alpha{i} beta gamma delta epsilon zeta eta {i}") for i in range(30)]
    df = spark.createDataFrame([(i, "so " + t + " it goes") for i, t in items], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = next(decontamination.indexes(bench, "item_id", "text", 0.8, 0.99)).find([r.text for r in df.orderBy("doc_id").collect()])
    parts = [ix for ix in decontamination.indexes(bench, "item_id", "text", 0.8, 0.99, block_bytes=300)]
    assert len(parts) > 1
    assert {(t, parts_ix.ids[k]) for parts_ix in parts for t, k, *_ in parts_ix.find([r.text for r in df.orderBy("doc_id").collect()])} == {(t, k) for t, k, *_ in whole}


# Repeated strings


def plain_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - 99):
            w = d[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        out[i] = (len(d), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("limit, lot", [(suffixdedup.FAMILY_LIMIT, suffixdedup.SORT_BYTES), (3, 2000)])
def test_repeats_equal_a_plain_search(spark, monkeypatch, limit, lot):
    monkeypatch.setattr(suffixdedup, "FAMILY_LIMIT", limit)
    monkeypatch.setattr(suffixdedup, "SORT_BYTES", lot)
    rng = random.Random(5)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randint(50, 400))) for _ in range(10)]
    rows = []
    for i in range(160):
        k, b = rng.randrange(6), rng.choice(base)
        t = ["a" * rng.randint(0, 400), "abc" * rng.randint(0, 150), b, b[: len(b) // 2] + "é" + b, b[rng.randrange(40) :] + "x" + b, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 300)))][k]
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, base[0] * 30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kept string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixdedup.remove_repeats(df).collect()}
    assert got == plain_removal(rows)


def test_repeats_of_odd_rows(spark):
    t = "".join(chr(97 + (i * i) % 26) for i in range(300)) + "end"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (7, t)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffixdedup.remove_repeats(df).collect())
    plain = plain_removal([(1, t)])[1][1]
    assert got == [("1", plain), ("1", plain), ("7", len(t)), ("None", 0)]
    assert suffixdedup.remove_repeats(df.limit(0)).count() == 0

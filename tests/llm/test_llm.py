"""Every operator against SQL, brute force or an exact round trip, and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from arcline.llm import common, components, decontaminate, jaccard, licenses, lines, mixing, pitman_yor, pseudonyms, registry, topk, toxicity, warc
from arcline.llm.common import in_order, key_filter, with_maybe

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def words(text):
    return WORD.findall((text or "").encode().lower())


ODD = [None, "", " \n\n\t ", "!!", "one", "A b C", "x" * 40_000, "word " * 12_000, "Ünïcode ÄB Kelvin K İ", "same text here for everyone to see twice or more", "same text here for everyone to see twice or more"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(registry.queries()[name], registry.oracle_sql()[name])


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.queries()) == list(range(1, 14))


# 1: mixing
def sainte_lague(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@pytest.mark.parametrize(("weights", "seats"), [([10.0, 7.0, 3.0], 20), ([1.0, 1.0, 1.0], 2), ([5.0, 0.0, 1.0], 7), ([1000.0, 1.0, 2.0, 3.0], 3), ([53.0, 24.0, 23.0], 100), ([1.0], 5), ([2.5, 2.5, 90.0, 4.0, 1.0], 0)])
def test_seats_go_by_highest_quotients(spark, weights, seats):
    df = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "i long, w double, n long")
    got = {r.i: r.quota for r in mixing.apportion(df, "w", "n", ["i"]).collect()}
    assert [got[i] for i in range(len(weights))] == sainte_lague(weights, seats)


def expected_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = budget / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    sources = [rng.choice(["a", "b", "c", "d", "é", "", None]) if rng.random() > 0.4 else "hot" for _ in range(600)]
    df = docs_of(spark, ["w " * rng.randrange(400) for _ in sources], sources).withColumn("size", F.lit("clash"))
    rows = mixing.mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.passes * r.size + sum(x["last"] - x["first"] + 1 for x in r.ranges)
    want = expected_targets(sizes)
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 3 * mixing.BLOCK_TOKENS for s in sizes)
    for parts in (4, 61):
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(parts)).collect()))
    in_pieces = defaultdict(int)
    for r in mixing.mixed_texts(df, mixing.mix(df)).collect():
        in_pieces[r.doc_id] += len(r.text.split())
    assert in_pieces == {r.doc_id: r.taken for r in rows if r.taken}


def test_seats_of_many_groups_by_range(spark):
    """Groups of unequal size, ranked together over several ranges."""
    rng = random.Random(12)
    groups = {g: [round(rng.random() * 50, 2) * (rng.random() < 0.9) for _ in range(n)] for g, n in enumerate([1, 2, 40, 300, 7])}
    seats = {g: rng.randrange(400) for g in groups}
    rows = [(f"g{g}", i, w, seats[g]) for g, x in groups.items() for i, w in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i long, w double, n long")
    for parts in (1, 13):
        got = {(r.g, r.i): r.quota for r in mixing.apportion(df.repartition(parts), "w", "n", ["g", "i"], ["g"]).collect()}
        for g, x in groups.items():
            if any(x):
                assert [got[f"g{g}", i] for i in range(len(x))] == sainte_lague(x, seats[g])


def test_running_sums_by_range(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 1000, float(i)) for i in range(1000)], "i long, k long, x double").repartition(9)
    got = {r.k: (r.n, r.s) for r in in_order(df.withColumn("one", F.lit(1).cast("long")), [F.col("k")], {"n": "one", "s": "x"}, "t").collect()}
    total, by_k = 0.0, {(i * 7919) % 1000: float(i) for i in range(1000)}
    for k in range(1000):
        assert got[k] == (k, total)
        total += by_k[k]


def test_mix_of_odd_rows(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = {r.doc_id: r for r in mixing.mix(docs_of(spark, ODD)).collect()}
    assert rows[0].size == rows[1].size == rows[2].size == 0 == rows[0].taken and rows[7].size == 12_000


# 2: pseudonyms
TEXT = 'Call +1 (988) 555-2485 or bosbt.42@mail8.example.com, 4041894974608795!! ip 70.123.182.155 v4.0. token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" 2021-02-28 30.02.2021 01/02/1999 123-45-6789 GB82 WEST 1234 5698 7654 32 4041-8949-7460-8795 1234567890123456 999.1.1.1 +44 20 7946 0958'


def test_permutation_is_one():
    for n in (1, 2, 7, 10, 97, 1000):
        out = [pseudonyms.permute(x, n, b"k", b"t") for x in range(n)]
        assert sorted(out) == list(range(n)) and [pseudonyms.permute(y, n, b"k", b"t", True) for y in out] == list(range(n))


def test_pseudonyms_keep_their_format(spark):
    new, counts = pseudonyms.replace(TEXT, b"key")
    assert pseudonyms.replace(new, b"key", True) == (TEXT, counts) and pseudonyms.replace(TEXT, b"other")[0] != new
    by_kind = dict(zip(pseudonyms.KINDS, counts, strict=True))
    assert by_kind == {"email": 1, "secret": 1, "iban": 1, "card": 2, "phone": 2, "ip": 1, "national_id": 1, "date": 2}
    for kept in ("30.02.2021", "1234567890123456", "999.1.1.1", "v4.0.", "@mail8.example.com"):
        assert kept in new
    cards = re.findall(r"\b4\d{15}\b|\b4\d{3}(?:-\d{4}){3}\b", new)
    assert len(cards) == 2 and len({c.replace("-", "") for c in cards}) == 1  # the same number stays the same, however written
    digits = cards[0].replace("-", "")
    assert pseudonyms.luhn(digits[:-1]) == int(digits[-1])
    iban = re.search(r"GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d", new)[0].replace(" ", "")
    assert pseudonyms._iban_number(iban) % 97 == 1
    df = docs_of(spark, [TEXT, None, "", "clean text, chapter 12"]).withColumn("n_pii", F.lit(-1))
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(df, b"key").collect()}
    assert out[0].text == new and out[0].n_pii == sum(counts) and (out[1].text, out[1].n_pii) == (None, 0) and out[3].text == "chapter 12".join(["clean text, ", ""])
    assert pseudonyms.reveal(pseudonyms.pseudonymise(df, b"key"), b"key").where("doc_id = 0").first().text == TEXT
    assert pseudonyms.pseudonymise(docs_of(spark, []), b"key").count() == 0


def test_equal_values_stay_linked_however_written():
    new = lambda t: pseudonyms.replace(t, b"key")[0]
    digits = lambda t: re.sub(r"[^0-9]", "", t)
    phones = ["+4915112345678", "+49 151 12345678", "+49-151-1234-5678", "+49 (151) 12345678"]
    assert len({digits(new(p)) for p in phones}) == 1 and digits(new(phones[0]))[:2] == "49" and new(phones[0]) != phones[0]
    american = ["+1 415 555 2671", "+14155552671", "(415) 555-2671", "415-555-2671", "415.555.2671"]
    assert len({digits(new(p))[-10:] for p in american}) == 1
    assert new("(415) 555-2671")[:1] == "(" and new("12.415.555.2671") == "12.415.555.2671" and new("115-555-2671") == "115-555-2671"
    dates = {"1999-12-31": (0, 1, 2), "1999/12/31": (0, 1, 2), "31.12.1999": (2, 1, 0), "31/12/1999": (2, 1, 0), "12/31/1999": (2, 0, 1)}
    found = {tuple(re.split(r"[^0-9]", new(d))[k] for k in order) for d, order in dates.items()}
    assert len(found) == 1 and int(next(iter(found))[2]) > 12
    for t in (*phones, *american, *dates, "02/03/2004", "token=" + "Ab9" * 3000, "api_key: " + "0a" * 64, "\u0661\u0662/\u0663\u0661/1999"):
        assert pseudonyms.replace(new(t), b"key", True)[0] == t
    assert new("\u0661\u0662/\u0663\u0661/1999") == "\u0661\u0662/\u0663\u0661/1999"  # digits beyond ASCII have no format here


def test_pseudonyms_of_long_texts_cost_in_proportion():
    def least(text):
        seconds = []
        for _ in range(3):
            began = time.process_time()
            pseudonyms.replace(text, b"key")
            seconds.append(time.process_time() - began)
        return min(seconds)

    for head, unit, n in (("", "%20%41", 40_000), ("", "a.b+", 60_000), ("secret=", "x1Y", 80_000), ("", "1 ", 120_000), ("", "+1", 120_000)):
        assert least(head + unit * 2 * n) < 3 * least(head + unit * n) + 0.05, unit


# 3: top-k
@pytest.mark.parametrize(("dim", "scale"), [(64, 1.0), (7, 1.0), (1, 3.0), (16, 3e6)])
def test_topk_is_exact(spark, dim, scale):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(260, dim)) * scale
    v[100:180] = v[100]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [float("nan")] * dim), (902, [None] * dim), (903, []), (904, [1.0, 2.0])]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in topk.search(df, df.where(F.col("vec_id") % 20 == 0), query_block=5, candidate_block=90).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = [[math.floor(64 * x) for x in r] for r in v]
    for q in range(0, 260, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in range(260) if c != q)[:20]
        assert got[q] == [(k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert set(got) == set(range(0, 260, 20))


@pytest.mark.parametrize("k", [3, 20])
def test_rows_that_repeat_an_id_are_candidates_each(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([20, 40, 1, 2, 3, 4, None]), [float(rng.randrange(-3, 4)) for _ in range(20)]) for _ in range(60)]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"_row": F.lit(1), "_own": F.lit(2), "v": F.lit("clash")}))
    want = []
    for i, (q, x) in enumerate(rows):
        if q is not None and q % 20 == 0:
            best = sorted((-64 * 64 * sum(a * b for a, b in zip(x, y, strict=True)), math.inf if c is None else c) for j, (c, y) in enumerate(rows) if j != i)[:k]
            want += [(q, n + 1, None if c == math.inf else c, -s) for n, (s, c) in enumerate(best)]
    for blocks in ((1024, 4096), (4, 7)):
        got = topk.search_within(df, F.col("vec_id") % 20 == 0, k, *blocks).collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, ((q, n, c, int(s)) for q, n, c, s in want)))


def test_topk_of_no_rows(spark):
    df = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(df, df).count() == 0


# 4: WARC
def test_warc_round_trip(spark):
    html = ["<p>same</p>", "<p>same</p>", None, "", "é\r\n\r\nWARC/1.1", "x" * 300_000, "<p>same</p>"] + [f"<html><body>{'word ' * 40}{i}</body></html>" for i in range(60)]
    pages = spark.createDataFrame([(i if i != 4 else None, f"http://h/{i}" if i % 3 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, archive_bytes=50_000)
    assert archives.count() > 1
    content = bytes(archives.first().content)
    assert content[:4] == bytes.fromhex("5d2a4d18")
    rows = warc.read_archives(archives).collect()
    assert not [r.error for r in rows if r.error] and len(rows) == len(html)
    got = {r.page_id: r for r in rows}
    for i, h in enumerate(html):
        r, raw = got[i if i != 4 else None], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), f"http://h/{i}" if i % 3 else None)
        assert r.record_type == "revisit" or bytes(r.payload) == raw
    assert [(got[k].record_type, got[k].refers_to) for k in (0, 1, 6, 2, 3)] == [("response", None), ("revisit", 0), ("revisit", 0), ("response", None), ("revisit", 2)]
    small = warc.read_archives(warc.write_archives(pages, min_revisit_bytes=5)).where("record_type = 'revisit'").collect()
    assert sorted(r.page_id for r in small) == [1, 6]
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_broken_archives_are_told(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    good = bytes(warc.write_archives(pages).first().content)
    bad = [good[:-3], good[:4], b"\0" * 40, b"", None, good.replace(b"WARC", b"XARC")]
    raw = list(warc.frames(good))[0]
    assert warc._parsed(raw)["record_type"] == "response"
    for change in (lambda r: r.replace(b"WARC/1.1", b"WARC/9"), lambda r: r[:-1], lambda r: r.replace(b"<p>0", b"<p>1"), lambda r: r.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError, match="."):
            warc._parsed(change(raw))
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bad)], "path string, content binary")
    out = defaultdict(list)
    for r in warc.read_archives(df).collect():
        out[r.path].append(r.error)
    assert len(out["0"]) == 5 and sum(e is not None for e in out["0"]) == 1 and out["1"] and out["2"] and "3" not in out and "4" not in out


# 5: lines
def one_edit(a, b):
    """By the table of edit distances."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1] <= 1


def near_lines(rows, min_words):
    """{place: all earlier places that are equal or, from ``min_words`` words on, within one edit} by comparing every two lines."""
    every = [((d, k), words(line)) for d, t in rows for k, line in enumerate((t or "").split("\n"))]
    every = [(p, w) for p, w in every if w]
    out = {}
    for p, w in every:
        before = [q for q, x in every if q < p and (w == x or min(len(w), len(x)) >= min_words and one_edit(w, x))]
        if before:
            out[p] = before
    return out


def test_near_lines_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Eps", "zeta", "éta"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(6, 14))] for _ in range(12)]
    texts = []
    for _ in range(60):
        made = []
        for _ in range(rng.randrange(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(k, rng.choice(vocabulary)), lambda: w.pop(k), lambda: w.insert(k, "new")])()
            made.append("  ".join(w) + rng.choice(["", ".", "!!"]))
        texts.append("\n".join(made))
    texts += [*ODD, "\n".join(["same text here for everyone to see twice or more"] * 3)]
    df = docs_of(spark, texts).withColumn("line_no", F.lit("clash")).withColumn("n_removed", F.lit("clash"))
    got = {(r.doc_id, r.line_no): (r.near_doc_id, r.near_line_no) for r in lines.near_duplicates(df).collect()}
    expected = near_lines(list(enumerate(texts)), lines.MIN_WORDS)
    assert got.keys() == expected.keys() and all(got[p] in expected[p] for p in got)
    left = {r.doc_id: r for r in lines.remove_lines(df, lines.near_duplicates(df)).collect()}
    for d, t in enumerate(texts):
        stay = [x for k, x in enumerate((t or "").split("\n")) if (d, k) not in got]
        if (d in left) != (any(words(x) for x in stay) or not any(q == d for q, _ in got)):
            raise AssertionError(d)
        if d in left:
            assert left[d].text == (None if t is None else "\n".join(stay))
    assert lines.near_duplicates(df.limit(0)).count() == 0


def test_short_lines_go_when_equal(spark, tmp_path):
    """Equal lines of one word or more go, but shorter lines than MIN_WORDS have no near ones."""
    texts = ["All rights reserved.\nHome\nthe first text has a line of its own here", "all rights  reserved\nall rights preserved\nHome\n!!\n!!", "ALL RIGHTS RESERVED", None, ""]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in lines.op5(spark, str(tmp_path)).collect()}
    assert {d: [tuple(x) for x in r.removed or []] for d, r in rows.items()} == {0: [], 1: [(0, 0, 0), (2, 0, 1)], 2: [(0, 0, 0)], 3: [], 4: []}
    df = docs_of(spark, texts)
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, str(tmp_path)).collect()}
    assert left == {0: texts[0], 1: "all rights preserved\n!!\n!!", 3: None, 4: ""}


# 6: language model
def tokens(text):
    return [*bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split(), b" "]


def test_base_scores_equal_brute_force_and_the_model_does_better(spark):
    rng = random.Random(6)
    follow = {w: [rng.choice("abcdefghij") for _ in range(2)] for w in "abcdefghij"}
    texts = []
    for _ in range(150):
        w = rng.choice("abcdefghij")
        out = [w]
        for _ in range(30):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.choice("abcdefghij") + str(rng.randrange(200))
            out.append(w)
            w = w[0]
        texts.append(" ".join(out))
    texts += ODD
    df = docs_of(spark, texts)
    rows = pitman_yor.score(df, train=toxicity.remainder("doc_id", 7) != 2, head=64, chunk_bytes=4000).collect()
    assert len(rows) == len(texts)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in enumerate(texts) if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    out = [r for r in rows if r.held_out and r.doc_id < 150]
    assert sum(r.score for r in out) > 0.85 * sum(r.base_score for r in out)
    by_id = {r.doc_id: r for r in rows}
    for parts, size in ((1, 4000), (6, 1 << 20)):  # however the table is cut into tasks, chunks and cells
        for r in pitman_yor.score(df.repartition(parts), train=toxicity.remainder("doc_id", 7) != 2, chunk_bytes=size).collect():
            assert math.isclose(r.score, by_id[r.doc_id].score, rel_tol=1e-9) and r[:5] == by_id[r.doc_id][:5]
    assert pitman_yor.score(df.limit(0), train=F.lit(True)).count() == 0
    assert all(math.isfinite(r.score) for r in pitman_yor.score(docs_of(spark, ["a b"]), train=F.lit(False)).collect())


def test_rare_words_have_contexts_of_their_own(spark):
    """A word of few occurrences predicts what follows it, however many other words there are."""
    rng = random.Random(66)
    pairs = [(f"u{i:03}xq", f"w{i:03}xq") for i in range(300)]  # the last bytes tell nothing
    texts = []
    for _ in range(3):
        rng.shuffle(pairs)
        texts += [" ".join(x for p in pairs[k : k + 10] for x in p) for k in range(0, 300, 10)]
    swapped = [" ".join(x for k in range(10) for x in (pairs[k][0], pairs[k + 10][1]))]
    right = [" ".join(x for p in pairs[:10] for x in p)]
    df = docs_of(spark, [*texts, *right, *swapped])
    rows = {r.doc_id: r for r in pitman_yor.score(df, train=F.col("doc_id") < len(texts), head=64, chunk_bytes=2000).collect()}
    assert rows[len(texts)].n_known == rows[len(texts) + 1].n_known == 21
    assert rows[len(texts)].score > rows[len(texts) + 1].score + 10  # 10 pairs, a power of ten each


@pytest.mark.parametrize(("c", "strength", "rise", "d"), [(2, 1.0, 0.1, 0.5), (40, 2.0, 0.1, 0.5), (64, 0.3, 0.02, 0.75), (65, 0.3, 0.02, 0.75), (300, 50.0, 0.5, 0.75), (1500, 20.0, 0.3, 0.6), (1500, 0.5, 0.01, 0.1)])
def test_seating_follows_its_law(c, strength, rise, d):
    """Tables of c customers by the exact law, all seatings summed up: to EXACT customers as it stands, beyond within 2 % of mean and 7 % of spread."""
    weight = lambda t: strength + rise * t
    k = np.arange(c + 2)
    log = np.full(c + 2, -np.inf)
    log[1] = 0.0
    for i in range(1, c):
        stay = np.where((k >= 1) & (k <= i), np.log(np.maximum(i - d * k, 1e-300)) + log, -np.inf)
        new = np.full(c + 2, -np.inf)
        new[1:] = log[:-1] + np.log(weight(k[:-1]))
        log = np.logaddexp(stay, new)
    p = np.exp(log - log.max())
    p /= p.sum()
    mean = (k * p).sum()
    spread = math.sqrt(((k - mean) ** 2 * p).sum())
    n = 6000
    t = pitman_yor.seat(np.full(n, c), lambda which, t: weight(t), d, pitman_yor._keys(np.arange(n), 1, 0))
    beyond = c > pitman_yor.EXACT
    assert abs(t.mean() - mean) < 4 * spread / math.sqrt(n) + 0.02 * beyond * mean and abs(t.std() / spread - 1) < 0.04 + 0.03 * beyond and t.min() >= 1 and t.max() <= c
    assert (pitman_yor.seat(np.array([0, 1, 100_000]), lambda which, t: 1.0 + 0 * t, d, np.arange(3).astype(np.uint64))[:2] == [0, 1]).all()


def test_binomials_follow_their_law():
    key = pitman_yor._keys(np.arange(20_000), 3, 1)
    for n, p in ((1, 0.3), (9, 0.9), (40, 0.5), (1000, 0.002), (1000, 0.7), (100_000, 0.4)):
        x = pitman_yor._binomial(np.full(len(key), n), np.full(len(key), p), key, 5)
        assert abs(x.mean() - n * p) < 4 * math.sqrt(n * p * (1 - p) / len(key)) and abs(x.std() / math.sqrt(n * p * (1 - p)) - 1) < 0.03 and x.min() >= 0 and x.max() <= n


def sequential_probabilities(pairs, size, rng, sweeps=400, burn_in=60):
    """Predictive probabilities of a two-level Pitman-Yor model, sampled one customer at a time: {(u, w): p}, averaged."""
    (d, s), (pd, ps) = pitman_yor.CONTEXT, pitman_yor.PARENT
    seats, parent = defaultdict(list), defaultdict(list)  # customers at each table
    every = [p for p, c in pairs.items() for _ in range(c)]
    n_u = Counter()
    total = [0, 0]  # the parent's customers and tables
    up = lambda w: (sum(parent[w]) - pd * len(parent[w]) + (ps + pd * total[1]) / (size - 1)) / (ps + total[0])
    t_u = lambda u: sum(len(x) for (v, _), x in seats.items() if v == u)

    def add(tables, open_weight, discount):
        weights = [x - discount for x in tables] + [open_weight]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def enter(u, w):
        n_u[u] += 1
        if add(seats[u, w], (s + d * t_u(u)) * up(w), d):
            total[1] += add(parent[w], (ps + pd * total[1]) / (size - 1), pd)
            total[0] += 1

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    for u, w in every:
        enter(u, w)
    out = Counter()
    for sweep in range(sweeps):
        for u, w in every:
            n_u[u] -= 1
            if leave(seats[u, w]):
                total[0] -= 1
                total[1] -= leave(parent[w])
            enter(u, w)
        if sweep >= burn_in:
            for u, w in pairs:
                x = seats[u, w]
                out[u, w] += (sum(x) - d * len(x) + (s + d * t_u(u)) * up(w)) / (s + n_u[u]) / (sweeps - burn_in)
    return out


def test_scores_are_near_a_sequential_sampler(spark):
    """On a small corpus the averaged probabilities are those of a sampler that moves one customer at a time."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a b c", "a b d", "b c a", "d d a"]) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    rows = pitman_yor.score(docs_of(spark, texts), train=F.lit(True), tails=4, least=1, burn_in=4, samples=30).collect()
    pairs = Counter()
    for t in texts:
        w = ["<", *t.split(), ">"]
        pairs.update(zip(w, w[1:], strict=False))
    p = sequential_probabilities(pairs, 4 + 1 + 5, random.Random(1))
    for r in rows:
        w = ["<", *texts[r.doc_id].split(), ">"]
        expected = sum(math.log10(p[x]) for x in zip(w, w[1:], strict=False))
        assert abs(r.score - expected) < 0.015 * r.n_tokens


# 7: toxicity
def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(7)
    plain = ["casa", "lumen", "vento", "morgen", "river", "stone", "wald"]
    texts, toxic = [], []
    for i in range(500):
        w = [rng.choice(plain) + rng.choice(["", "o", "er"]) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Moron!", "zgruk" + rng.choice(["a", "ento", "isch", "oli"])]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    df = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.sample(df, labels, toxicity.remainder("doc_id", 3) != 1))
    rows = {r.doc_id: r for r in toxicity.score(df.withColumn("score", F.lit("clash")), model).collect()}
    wrong = [i for i, t in enumerate(toxic) if rows[i].predicted != t]
    assert not wrong and all(0 <= r.score <= 1 for r in rows.values()) and rows[500].predicted == rows[501].predicted == 0
    assert toxicity.score(df.limit(0), model).count() == 0
    again = df.union(df.where("doc_id < 9")).union(docs_of(spark, ["x"] * 400).withColumn("doc_id", F.lit(4).cast("long")))
    assert toxicity.sample(again, labels, F.lit(True), max_rows=10).count() == 10 and toxicity.sample(again, labels, F.lit(True)).count() == 500
    long = toxicity.score(docs_of(spark, ["casa vento " * 200_000, "casa vento " * 200_000 + "idiot"]), model).orderBy("doc_id").collect()
    assert long[0].predicted == 0 and long[1].score > long[0].score
    bare = toxicity.fit(toxicity.sample(df, labels.limit(0), F.lit(True)))
    assert [r.predicted for r in toxicity.score(docs_of(spark, ["you idiot", "fine day"]), bare).orderBy("doc_id").collect()] == [1, 0]


# 8: decontamination
def brute_hits(text, items, n=13):
    w = words(text)
    hit, found = set(), set()
    for k, item in items:
        own = words(item)
        m = min(n, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(k)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_marks_equal_brute_force(spark, block):
    rng = random.Random(8)
    items = [(str(k), " ".join(rng.choice("abcde") + str(rng.randrange(9)) for _ in range(rng.choice([3, 13, 20, 30])))) for k in range(12)] + [("12", ""), ("13", "!!"), ("14", "Ünï Cödé")]
    texts = [*ODD, *[" ".join(rng.choice(["x", "y", rng.choice(items)[1], rng.choice(items)[1][:40]]) for _ in range(rng.randrange(1, 30))) for _ in range(40)], "ünï, cödé", "Ünï CÖDÉ"]
    df = docs_of(spark, texts).withColumn("spans", F.lit("clash"))
    bench = spark.createDataFrame([(int(k), t) for k, t in items] + [(99, None)], "item_id long, text string")
    marked = decontaminate.mark(df, bench, max_block_words=block)
    for r in marked.collect():
        n, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.item_ids, r.n_items) == (n, hit, found, len(found))
        assert r.contaminated == (hit > 0 and 20 * hit >= n) and sum(s["last"] - s["first"] + 1 for s in r.spans) == hit
    for r in decontaminate.remove_spans(marked).collect():
        assert len(words(r.text)) == r.n_words - r.n_hit
    assert decontaminate.mark(df.limit(0), bench).count() == 0
    assert decontaminate.mark(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_the_index_is_compact_and_one_block_lives_at_a_time(spark, monkeypatch):
    rng = random.Random(81)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    windows, size = decontaminate._Index([("a", text), ("b", text[:3000])], 13).size()
    assert windows >= 19_988 and size < 50 * windows
    live, most = set(), []

    class Held:
        def __init__(self, value):
            self.value = value
            live.add(self)
            most.append(len(live))

        def destroy(self):
            live.discard(self)

    monkeypatch.setattr(decontaminate, "_marker", lambda index: lambda column: F.lit(None).cast(decontaminate.FOUND))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: Held(value))
    bench = spark.createDataFrame([(1, text), (2, "short one")], "item_id long, text string")
    decontaminate.mark(docs_of(spark, [text, "x"]), bench, max_block_words=2000).count()
    assert len(most) >= 10 and max(most) == 1


# 9: licences
def test_licences(spark):
    texts = [*ODD, "Released  under THE MIT-License. under the mit license under the mit license", "This work is licensed under the GNU General Public License, version 3.", "licensed under apache, license: version 2!", "cc by nc", "x " * 500 + "Licensed under CC BY-SA 4.0.", "mit license der",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "the gnu general store has a public license version", "Kelvin mit"]
    rows = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        w = [x.decode() for x in words(t)]
        places = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    k = len(ODD)
    assert [rows[k + i].labels for i in range(8)] == ["mit", "gpl-3", "apache-2", "cc-by-nc", "cc-by-sa", "", "mit", ""]
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_notices_of_many_licences_are_all_found(spark):
    """A third-party notices file holds most licence words; none of its notices may fall out for that."""
    texts = ["\n\n".join(notice for _, _, notice in licenses.TEMPLATES), *["license licensed version gnu general public"] * 30, *["nothing of that kind"] * 30]
    row = next(r for r in licenses.scan(docs_of(spark, texts)).collect() if r.doc_id == 0)
    assert row.labels.split(",") == sorted({label for label, _, _ in licenses.TEMPLATES})


def test_a_lone_licence_word_is_aligned(spark):
    """'CC BY 4.0' holds one licence word only, which weighs enough where it is rare."""
    texts = ["CC BY 4.0", *["licensed to drive"] * 30]
    rows = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert rows[0].labels == "cc-by" and rows[0].score > licenses.LEAST_SHARE and rows[1].labels == ""


def test_licence_scan_is_native(spark, sf_dir):
    plan = registry.queries()["op9_licenses"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 10: Jaccard
def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(10)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 200))] for _ in range(8)]
    texts = list(ODD)
    for _ in range(140):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(50))
        texts.append(" ".join(w))
    df = docs_of(spark, texts).withColumn("bands", F.lit("clash"))
    got = {r.doc_id: r for r in jaccard.join(df, block=16).collect()}
    sets = [shingles(t) for t in texts]
    link = lambda a, b: a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if link(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    for d in range(len(texts)):
        assert (got[d].class_id, got[d].n_links) == (root[d], sum(bool(link(d, b)) for b in range(len(texts))))
        assert got[d].copies == (sum(s == sets[d] for s in sets) if sets[d] else 1)
    assert jaccard.join(df.limit(0)).count() == 0


def test_bands_reach_their_recall():
    for s, r in ((0.8, 0.995), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = jaccard.bands_and_rows(s, r)
        assert 1 - (1 - s**rows) ** bands >= r and bands * rows <= 256


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_bitmaps_miss_nothing(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    df = with_maybe(spark.range(5000), "id", key_filter(keys, "k"))
    assert df.where("_maybe").count() >= 715 and df.where("not _maybe and id % 7 = 0").count() == 0 and df.where("_maybe").count() < 800
    assert with_maybe(spark.range(50), "id", key_filter(keys.limit(0), "k")).where("_maybe").count() == 0


def test_batches_are_small_while_operators_run(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    outer, inner = common.small_batches(spark), common.small_batches(spark)
    outer.__enter__()
    inner.__enter__()
    outer.__exit__(None, None, None)  # another thread's may leave first
    assert spark.conf.get(key) == str(common.BATCH_ROWS)
    inner.__exit__(None, None, None)
    assert spark.conf.get(key) == before
    try:
        spark.conf.set(key, "50")
        with pytest.raises(ZeroDivisionError), common.scratch(spark):
            assert spark.conf.get(key) == "50"
            1 / 0
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.set(key, before)


def test_rows_that_share_or_lack_an_id(spark):
    t = "a quick brown fox jumps over the lazy dog and runs into the deep dark woods again"
    df = spark.createDataFrame([(1, t, "en", "s", 1), (1, t, "en", "s", 1), (1, "quite another text of many words than the other one that has this id", "en", None, 1), (None, t, None, "s", None), (None, None, None, None, None)], DOC)
    bench = spark.createDataFrame([(1, t)], "item_id long, text string")
    assert mixing.mix(df).count() == 5 and jaccard.join(df).count() == 5 and licenses.scan(df).count() == 5
    assert sorted(r.copies for r in jaccard.join(df).collect()) == [1, 1, 3, 3, 3]
    assert decontaminate.mark(df, bench).where("contaminated").count() == 3
    assert pitman_yor.score(df, train=F.lit(True)).count() == 5
    assert lines.remove_lines(df, lines.near_duplicates(df)).count() >= 3
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    records = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted(r.record_type for r in records) == ["response"] * 3 + ["revisit"] * 2


def test_lines_of_one_document_cost_in_proportion(spark):
    """One document of many near lines: twice the lines take no more than about twice the time."""
    def seconds(n):
        text = "\n".join(f"this line {i % (n // 2)} r{i % (n // 2)} of a long document is like another one {'here' if i < n // 2 else 'there'}" for i in range(n))
        df = docs_of(spark, [text, "short"])
        began = time.perf_counter()
        left = lines.remove_lines(df, lines.near_duplicates(df)).where("doc_id = 0").first()
        assert left.text.count("\n") + 1 == n // 2 == left.n_removed
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 3 * seconds(8_000)


def test_near_groups_give_rows_in_proportion(spark, monkeypatch):
    """Of n near copies of a page, what the join stages for members, links and trees has about n rows, and links are counted whole."""
    def staged_rows(n):
        rng = random.Random(3)
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts = []
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(150)] = f"c{rng.randrange(40)}"
            texts.append(" ".join(w))
        seen = Counter()
        plain = jaccard.stage

        def counting(df, label):
            out = plain(df, label)
            seen[label] += out.count()
            return out

        with monkeypatch.context() as m:
            m.setattr(jaccard, "stage", counting)
            rows = jaccard.join(docs_of(spark, texts), block=32).collect()
        sets = [shingles(t) for t in texts]
        for r in rows[:: n // 25]:
            assert r.n_links == sum(5 * len(sets[r.doc_id] & x) >= 4 * len(sets[r.doc_id] | x) for x in sets) - 1
        return seen

    small, large = staged_rows(300), staged_rows(600)
    assert large["classes"] > 1.7 * small["classes"]
    for label in ("members", "found", "apart", "ids"):
        assert small[label] > 0 and large[label] < 2.6 * small[label], label


def test_intersections_of_any_share(spark):
    rng = np.random.default_rng(5)
    a = [np.unique(rng.choice(m, rng.integers(0, 40)).astype(np.uint64)) for m in [10, 50, 1000, 5000] * 20]
    b = [np.unique(rng.choice(m, rng.integers(0, 40)).astype(np.uint64)) for m in [12, 60, 900] * 15]
    got = jaccard._shared(jaccard._Sorted(a), jaccard._Sorted(b))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert jaccard._shared(jaccard._Sorted([]), jaccard._Sorted(b)).shape == (0, 45)


def test_clashing_columns_change_nothing(spark):
    """Extra columns named like results or like what the operators use inside."""
    t = "a quick brown fox jumps over the lazy dog under the mit license and runs away"
    df = docs_of(spark, [t, t, None, "", "other words stand here"])
    extra = df
    for name in ("class_id", "n_links", "size", "target", "taken", "labels", "score", "n_tokens", "held_out", "line_no", "near_doc_id", "_row", "_text", "_id", "_source", "_words", "_train", "bucket", "chunk", "grams", "places"):
        extra = extra.withColumn(name, F.lit("clash"))
    for run in (jaccard.join, mixing.mix, licenses.scan, lines.near_duplicates, lambda d: pitman_yor.score(d, train=F.lit(True))):
        assert sorted(map(str, run(extra).collect())) == sorted(map(str, run(df).collect()))
    vectors = spark.createDataFrame([(i, [float(i), 1.0], "clash", "clash") for i in range(5)], "vec_id long, embedding array<double>, score string, rank string")
    found = topk.integer_vectors(vectors)
    assert topk.search(found, found).count() == 20
    pages = spark.createDataFrame([(1, "u", "x", "clash", "clash")], "page_id long, url string, html string, payload string, _sha string")
    assert warc.read_archives(warc.write_archives(pages)).first().payload_bytes == 1

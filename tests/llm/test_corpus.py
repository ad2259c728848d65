"""Each corpus operator against a brute-force version, and its edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.llm import (
    compact_windows, cross_entropy, dart_minhash, language_id, licence_scan, pareto_mix, piece_codec, subspace_join, syncmers, url_filter,
)
from quayside.llm import common
from quayside.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "in", "or", "ust", "ill")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def documents(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"s{i % 3}"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def edited(text, every):
    w = text.split()
    return " ".join("changed" if i % every == every // 2 else x for i, x in enumerate(w))


#: nulls, empty, short, blank, tied, repeated and long texts
EDGES = [None, "", "   ", "one", "one", "a b c d", "a b c d", "!!! ??? 123", prose(1, 300), prose(1, 300), "x" * 70_000, "same " * 3000]


def odd(spark):
    """Edge texts with null ids, null labels, repeated rows and columns whose names operators use inside."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None) for i, t in enumerate(EDGES)]
    rows += [(None, prose(1, 300), None, None, None), rows[3], rows[3]]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({"id": F.lit(1), "score": F.lit("x"), "_0": F.lit(2), "band": F.lit(3), "rep": F.lit(None).cast("string"), "_id": F.lit(4)})


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (100, 3)] + [(50, i) for i in range(51, 90)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got[100] == 1 and got[3] == 1 and got[9] == 7 and got[89] == 50 and 5 not in got


# -- 1


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec()


def test_pieces_equal_the_model(codec):
    r = random.Random(3)
    texts = [prose(2, 200), "  two  blanks   three ", "\t\n\r\n x", "Äöü ß é ñ 中文 𝒳 　  ", "a" * 300, "aaab" * 50, " " * 40, "don't stop_now #1 (2.50)"]
    texts += ["".join(r.choice("abcdehilnorst ▁  éß中.,!0") for _ in range(r.randrange(1, 200))) for _ in range(400)]
    for t in texts:
        assert codec.encode(t).tolist() == codec.model.encode(t), t
        ids = codec.encode(t)
        assert codec.decode(np.array([0, len(ids)]), ids) == [codec.model.decode(ids.tolist())]


def test_lattice_commits_like_the_whole(codec):
    text = codec.model.normalize(prose(4, 400)).replace("▁", "x")  # one long word, many windows
    ids = [i for piece in codec.merged(text) for i in codec.spelled(piece)]
    assert list(codec.lattice(text)) == ids and codec.encode_all([text.replace("x", " ")])[0].tolist() == codec.model.encode(text.replace("x", " "))


def test_unigram_lattice_is_viterbi(codec):
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -2.2, "c": -1.0, "bc": -1.1}
    model = object.__new__(piece_codec.Codec)
    model.scores, model.ids, model.bytes, model.unk = scores, {k: i for i, k in enumerate(scores)}, {}, 99
    model.longest, model.bpe, model.unknown_score, model.pairs = 3, False, -20.0, {}
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choice("abcz") for _ in range(r.randrange(1, 60)))
        best = [(0.0, [])]
        for i in range(1, len(text) + 1):
            options = [(best[i - n][0] + (scores.get(text[i - n : i], -20.0)), best[i - n][1] + [text[i - n : i]]) for n in (3, 2, 1) if i >= n and (n == 1 or text[i - n : i] in scores)]
            best.append(max(options, key=lambda o: o[0]))
        got = list(model.lattice(text))
        total = sum(list(scores.values())[i] if i != 99 else -20.0 for i in got)
        assert math.isclose(total, best[-1][0], abs_tol=1e-9)


def test_encode_and_decode_tables(spark):
    out = piece_codec.encode(odd(spark), ["doc_id", "text", "score"])
    rows = out.collect()
    assert len(rows) == len(EDGES) + 3
    assert all(r["decoded"] == r["text"] for r in rows) and all((r["ids"] is None) == (r["text"] is None) for r in rows)
    again = piece_codec.decode(out.drop("decoded"), ["doc_id", "text"]).collect()
    assert all(r["decoded"] == r["text"] for r in again)
    assert piece_codec.encode(odd(spark).limit(0), ["doc_id"]).count() == 0


# -- 2


def brute_scores(seqs, good):
    """Losses of each text under the target and the background, without its own counts."""
    models = []
    for pick in (good, seqs):
        bi, uni = Counter(), Counter()
        for i in pick:
            uni.update(seqs[i])
            bi.update(zip(["", *seqs[i]], seqs[i]))
            uni[""] += bool(seqs[i])
        models.append((bi, uni, sum(n for w, n in uni.items() if w)))
    n, n_good = models[1][2], models[0][2]
    out = {}
    for i, s in seqs.items():
        own, own_bi = Counter(s) + Counter({"": 1}), Counter(zip(["", *s], s))
        losses = []
        for k, (bi, uni, total) in enumerate(models):
            scale = n_good / n if k and n_good else 1.0
            mine = 1 if k or i in good else 0
            loss = 0.0
            for v, w in zip(["", *s], s):
                single = (scale * (uni[w] - mine * own[w]) + cross_entropy.FLOOR) / (scale * (total - mine * len(s)) + cross_entropy.FLOOR * n)
                loss -= math.log((scale * (bi[v, w] - mine * own_bi[v, w]) + cross_entropy.PRIOR * single) / (scale * (uni[v] - mine * own[v]) + cross_entropy.PRIOR))
            losses.append(loss / len(s) if s else None)
        out[i] = losses
    return out


@pytest.mark.parametrize("chars, merged", [(cross_entropy.CHARS, False), (3_000, True)])
def test_cross_entropy_against_brute_force(spark, monkeypatch, chars, merged):
    monkeypatch.setattr(cross_entropy, "CHARS", chars)  # one slice, or many in a task
    monkeypatch.setattr(cross_entropy, "FEW_LABELS", 0 if merged else 1000)
    texts = [prose(i, 20 + i) + (" good stuff here" if i % 2 else "") + f" only{i} once{i}" for i in range(60)] + [None, "", prose(3, 23)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 50)] + [(None, 1, 0), (1, 0, 0), (61, 1, 0)], "doc_id long, quality int, toxic int")
    rows = cross_entropy.score(documents(spark, texts), labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    want = brute_scores({i: (t or "").lower().split() for i, t in enumerate(texts)}, {i for i in range(50) if i % 2} | {61})
    for i, (target, background) in want.items():
        if target is None:
            assert got[i]["score"] is None and got[i]["n_words"] == 0
            continue
        assert math.isclose(got[i]["target_loss"], target, rel_tol=1e-9) and math.isclose(got[i]["background_loss"], background, rel_tol=1e-9)
        assert math.isclose(got[i]["score"], target - background, abs_tol=1e-9)


def test_cross_entropy_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(cross_entropy.score(odd(spark), labels).collect()) == len(EDGES) + 3
    rows = cross_entropy.score(documents(spark, ["a b", "a c", None]), labels.limit(0)).collect()  # a uniform target
    assert all(r["score"] is None or math.isclose(r["target_loss"], math.log(4)) for r in rows)
    assert cross_entropy.score(odd(spark).limit(0), labels).count() == 0


# -- 3


def test_mix_targets_and_sample(spark):
    r = random.Random(1)
    texts = [prose(i, r.randrange(1, 60)) for i in range(900)] + [None, ""]
    sources = {i: ("hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)} | {900: None, 901: "void"}
    rows = pareto_mix.mix(documents(spark, texts, sources=sources), pareto_mix.repeating_weight()).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    by = Counter()
    for i in size:
        by[sources[i]] += size[i]
    names = sorted((s for s in by if s), key=lambda s: s.encode()) + [None]
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    target, free, rest = {}, set(by), sum(by.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * by[s]}
        for s in over or free:
            target[s] = 3 * by[s] if over else level * weight[s]
        rest -= sum(3 * by[s] for s in over)
        free = free - over if over else set()
    took = Counter()
    for x in rows:
        assert x["size"] == size[x["doc_id"]] and math.isclose(x["target"], target[x["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= x["copies"] <= 3 and x["taken"] == x["copies"] * x["size"]
        took[x["source"]] += x["taken"]
    assert all(abs(took[s] - target[s]) <= 5 for s in by)
    again = pareto_mix.mix(documents(spark, texts, sources=sources).repartition(7), pareto_mix.repeating_weight()).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in rows) == sorted((x["doc_id"], x["taken"]) for x in again)


def test_mix_goes_past_a_document_that_does_not_fit(spark):
    texts = [prose(1, 20_000)] + [prose(i, 10) for i in range(2, 1002)] + [prose(5000 + i, 10) for i in range(2000)]
    sources = {i: "a" if i < 1001 else "b" for i in range(3001)}
    rows = pareto_mix.mix(documents(spark, texts, sources=sources), F.when(F.col("source") == "a", 0.3).otherwise(0.7)).collect()
    took = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in "ab"}
    target = {r["source"]: r["target"] for r in rows}
    assert math.isclose(target["a"], 15_000) and took["a"] == 10_000  # all short ones; the long one would be 5,000 too much
    assert abs(took["b"] - target["b"]) <= 10


def test_mix_edges(spark):
    assert pareto_mix.mix(odd(spark), pareto_mix.repeating_weight()).count() == len(EDGES) + 3
    assert pareto_mix.mix(odd(spark).limit(0), pareto_mix.repeating_weight()).count() == 0
    assert pareto_mix.mixed_documents(odd(spark)).columns == odd(spark).columns


# -- 4


def brute_links(rows):
    good = {}
    for i, e, label in rows:
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good[i] = (np.array(e, np.float64), label)
    ids = sorted(good)
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            (a, la), (b, lb) = good[i], good[j]
            if la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, _, _ in rows}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        base = np.random.default_rng(i % 40).standard_normal(64)
        noise = rng.standard_normal(64) * (0.02 + 0.25 * rng.random())
        rows.append((i, (base + noise).astype(np.float32).tolist() if i % 9 else base.astype(np.float32).tolist(), i % 40 % 3))
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 64, 1), (403, [float("nan")] * 64, 1), (404, [None, 1.0], 1), (405, rows[5][1], None), (406, [1.0, 2.0], 1), (407, [1e-30, 2e-30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(0), "h": F.lit("x")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in subspace_join.linked_vectors(df).collect()}
    assert got == brute_links(rows)


def test_vectors_of_repeated_and_text_ids_and_labels_by_value(spark):
    e = [float(x) for x in np.random.default_rng(1).standard_normal(64)]
    rows = [(1, e, 1.2), (2, e, 1.7), (3, e, 1.2), (5, e, 2.0), (5, [-x for x in e], 2.0), (6, [x * 1.001 for x in e], 2.0)]
    got = sorted(tuple(r)[:3] for r in subspace_join.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label double")).collect())
    assert got == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (5, 0, 5), (5, 1, 5), (6, 1, 5)]
    rows = [("a", e, "x"), ("b", e, "y"), ("c", e, "x"), (None, e, "x")]
    got = {tuple(r)[:3] for r in subspace_join.linked_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<float>, label string")).collect()}
    assert got == {("a", 1, "a"), ("b", 0, "b"), ("c", 1, "a"), (None, 0, None)}


def test_few_pairs_of_a_block_are_compared():
    x = np.random.default_rng(7).standard_normal((800, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ subspace_join.rotation(64)
    n = 0
    for lo, hi in subspace_join.cut_points(64, subspace_join.BLOCKS):
        radius = np.sqrt(0.04 * (hi - lo) / 64)
        n += sum(len(i) for i, _ in subspace_join.close_pairs(x[:, lo:hi], x[:, lo:hi], radius, subspace_join.GRID)) - 800
    assert n < 0.1 * 800 * 799


def test_vectors_tiles_and_empty(spark, monkeypatch):
    monkeypatch.setattr(subspace_join, "TILE", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    rows = [(i, (base + rng.standard_normal(64) * 0.1).astype(np.float32).tolist(), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in subspace_join.linked_vectors(df).collect()}
    assert got == brute_links(rows)
    assert subspace_join.linked_vectors(df.limit(0)).count() == 0


# -- 5


def test_compact_windows_cover_each_range_once():
    r = np.random.default_rng(1)
    for n, top in ((30, 5), (40, 1000), (25, 1)):
        h = r.integers(0, top, n).astype(np.uint64)
        l, c, e = compact_windows.compact_windows(h, np.array([0, n]), 6)  # noqa: E741
        for a in range(n):
            for b in range(a + 5, n):
                own = [k for k in range(len(c)) if l[k] <= a <= c[k] <= b <= e[k]]
                assert len(own) == 1 and h[c[own[0]]] == h[a : b + 1].min() and c[own[0]] == a + int(h[a : b + 1].argmin())


def test_passages_are_found_and_others_left(spark):
    shared, near = prose(100, 80), prose(101, 120)
    texts = [prose(i, 150) for i in range(40)]
    texts[3] += " " + shared
    texts[9] = prose(9, 30) + " " + shared + " " + prose(99, 30)
    texts[12] = shared
    texts[20] += " " + near
    w = near.split()
    w[60] = "edited"
    texts[25] = prose(25, 40) + " " + " ".join(w)
    texts[30] = texts[31] = prose(30, 60)
    texts[35] = texts[36] + " " + " ".join(shared.split()[:45])
    rows = compact_windows.repeated_passages(documents(spark, texts)).collect()
    pairs = {(r["doc_id"], r["first_id"]) for r in rows}
    assert {(9, 3), (12, 3), (25, 20), (31, 30), (36, 35)} <= pairs
    assert {d for d, _ in pairs} == {9, 12, 25, 31, 36}
    r9 = next(r for r in rows if r["doc_id"] == 9)
    assert texts[9].split()[r9["start_word"] : r9["end_word"]] == shared.split()
    cut = {r["doc_id"]: r for r in compact_windows.cut_repeats(documents(spark, texts)).collect()}
    assert 12 not in cut and 31 not in cut and cut[3]["text"] == texts[3]
    assert cut[9]["text"] == prose(9, 30) + " " + prose(99, 30) and cut[9]["n_chars"] == len(cut[9]["text"])


def test_exact_repeats_against_brute_force(spark):
    r = random.Random(4)
    pool = [prose(200 + i, 30) for i in range(12)]  # shorter than a passage: many share a part, few a whole
    texts = [" ".join(r.choice(pool) for _ in range(6)) for _ in range(60)]
    got = {}
    for x in compact_windows.repeated_passages(documents(spark, texts)).collect():
        got.setdefault(x["doc_id"], []).append((x["start_word"], x["end_word"]))
    first = {}
    words = [t.split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                assert any(a <= k and k + 50 <= b for a, b in got.get(i, [])), (i, k)


def test_near_passages_behind_crowding_leads(spark):
    texts, want = [], set()
    near = lambda p, i: [x if k != random.Random(i).randrange(5, 55) else "changed" for k, x in enumerate(p)]
    for i in range(60):  # earlier documents share 45 words of each passage
        texts.append(prose(i, 80) + " " + " ".join(prose(5000 + i, 60).split()[8:53]) + " " + prose(9000 + i, 40))
    texts += [prose(1000 + i, 60) + " " + prose(5000 + i, 60) + " " + prose(11000 + i, 30) for i in range(60)]
    texts += [prose(2000 + i, 60) + " " + " ".join(near(prose(5000 + i, 60).split(), i)) + " " + prose(12000 + i, 30) for i in range(60)]
    want = {(120 + i, 60 + i) for i in range(60)}
    got = {(r["doc_id"], r["first_id"]) for r in compact_windows.repeated_passages(documents(spark, texts)).collect()}
    assert len(want & got) >= 0.95 * len(want) and got <= want


def test_leads_come_from_hash_aggregates_and_are_the_least(spark):
    rows = [(1, 7, 90, False), (1, 7, 80, True), (1, 5, 70, False), (1, 5, 60, True), (2, 4, 1, True), (2, 4, 2, False)]
    keyed = common.shared_table(spark.createDataFrame(rows, "key long, id long, at long, first boolean"))
    written, stored = [], compact_windows.shared_table
    compact_windows.shared_table = lambda df: written.append(df) or stored(df)
    try:
        got = compact_windows.starred(keyed).collect()
    finally:
        compact_windows.shared_table = stored
    assert {(x["key"], x["id"], x["at"], x["lead"], x["lead_at"], x["n"]) for x in got} == {(1, 7, at, 5, 60, 4) for at in (80, 90)}
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    r = np.random.default_rng(8)
    for top in (2, 2**31):
        b = r.integers(-top, top, 300).astype(np.int32)
        values, at = compact_windows.sorted_places(b)
        assert (at == np.argsort(b, kind="stable")).all() and (values == b[at]).all()
    for n, top in ((30, 5), (40, 1000), (25, 1)):
        h = r.integers(0, top, n).astype(np.uint64)
        _, c, _ = compact_windows.compact_windows(h, np.array([0, n]), 6)
        assert set(h[c]) == set(h[compact_windows.minima(h, np.array([0, n]), 6)])


def test_near_windows_of_a_key_meet_all_earlier_ones(spark):
    r = np.random.default_rng(3)
    fresh = lambda n: r.integers(-(2**31), 2**31, n).astype(np.int32)

    def near(x, *places):
        x = x.copy()
        for p in places:
            x[p : p + 5] = fresh(5)
        return x

    one, two, inner = fresh(60), fresh(60), fresh(60)
    # 8 is near 7, behind six leads that share nothing; 10 is near 9, which the first lead covers, but not near that
    # lead; 11 is near a second window of a lead's text
    texts = [one, *(fresh(60) for _ in range(6)), two, near(two, 30), near(one, 25)]
    texts += [near(texts[9], 38), near(inner, 30)]
    texts[1] = np.concatenate([texts[1], inner])
    places = [(i, 20) for i in range(len(texts))] + [(1, 80)]
    keyed = spark.createDataFrame([(5, i, c, True, c == 20) for i, c in places], "key long, id long, at long, near boolean, first boolean")
    shingled = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(texts)], "id long, sh array<int>")
    want = set()
    for a, c in places:
        for b, d in places:
            if b < a and compact_windows.compared(texts[a], texts[b], np.array([c]), np.array([d]), 46, 0.8)[0]:
                want.add((a, b))
    assert {(8, 7), (9, 0), (10, 9), (11, 1)} == want
    got = {(x["id"], x["lead"]) for part in compact_windows.again(common.shared_table(keyed), common.shared_table(shingled), 46, 0.8) for x in part.where(F.size("spans") > 0).collect()}
    assert got == want


def test_matches_held_at_once_are_few():
    assert compact_windows.MATCHES * 8 * 6 < 32e6  # bytes of the six arrays of a tile's step


def test_repeated_and_text_ids_keep_their_texts(spark):
    shared = prose(77, 60)
    rows = [(1, prose(1, 100) + " " + shared), (2, shared + " " + prose(3, 80)), (2, prose(4, 200))]
    cut = compact_windows.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in cut) == sorted([rows[0], (2, prose(3, 80)), rows[2]])
    named = spark.createDataFrame([("a", rows[0][1]), ("b", rows[1][1]), (None, shared)], "doc_id string, text string")
    assert [(r["doc_id"], r["first_id"], r["start_word"], r["end_word"]) for r in compact_windows.repeated_passages(named).collect()] == [("b", "a", 0, 60)]


def test_repetitive_long_texts(spark):
    a, b = ("x y z " * 3000) + prose(1, 100), prose(2, 100) + (" x y z" * 4000)
    rows = compact_windows.repeated_passages(documents(spark, [a, b, "word " * 9000, "word " * 7000])).collect()
    assert {(r["doc_id"], r["first_id"]) for r in rows} == {(1, 0), (3, 2)}
    covered = np.zeros(13000, bool)
    for r in rows:
        if r["doc_id"] == 1:
            covered[r["start_word"] : r["end_word"]] = True
    assert covered[105:12000].all()


def test_passages_edges(spark):
    rows = compact_windows.repeated_passages(odd(spark)).collect()
    assert {(r["doc_id"], r["first_id"]) for r in rows} == {(9, 8)}
    kept = compact_windows.cut_repeats(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("doc_id is null").count() == 1
    assert compact_windows.cut_repeats(odd(spark).limit(0)).count() == 0


# -- 6


def test_fingerprints(spark):
    texts = [prose(i, 200) for i in range(12)] + [None, "", "one two", "x" * 500]
    texts[5] = texts[4]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(docs).collect()}
    import hashlib

    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        nxt, n = full[i - 1], len(t)
        m = n // 3
        want = t[: n - m] + nxt[:m]
        assert rows[i]["n_chars"] == n and rows[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] and rows[5]["near_next"] == 1.0
    plain = [i for i in range(12) if i not in (4, 5, 6)]
    assert all(rows[i]["near_edited"] > 0.2 and rows[i]["near_next"] < 0.05 for i in plain)
    assert rows[12]["fingerprint"] == "" == rows[13]["fingerprint"] and len(rows[14]["fingerprint"]) == 16


def test_fingerprint_anchors_are_closed_syncmers(spark):
    text = prose(7, 60)
    words = spark.createDataFrame([(i, w) for i, w in enumerate(text.split())], "i int, w string")
    h = [r["h"] for r in words.select("i", F.xxhash64("w").alias("h")).orderBy("i").collect()]
    pairs = spark.createDataFrame([(i, h[i], h[i + 1]) for i in range(len(h) - 1)], "i int, a long, b long")
    s = [r["s"] for r in pairs.select("i", F.xxhash64("a", "b").alias("s")).orderBy("i").collect()]
    closed = [i for i in range(len(h) - 4) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])]
    mers = spark.createDataFrame([(i, *h[i : i + 5]) for i in closed], "i int, a long, b long, c long, d long, e long")
    x = {r["i"]: r["x"] for r in mers.select("i", F.xxhash64("a", "b", "c", "d", "e").alias("x")).collect()}
    want = " ".join(f"{x[i] & (2**64 - 1):016x}" for i in closed)
    got = documents(spark, [text]).select(syncmers.fingerprint(F.col("text")).alias("f")).first()["f"]
    assert got == want


def test_fingerprints_grow_with_the_text(spark):
    long = prose(8, 3000)
    texts = [long, " ".join("edit" if i % 500 == 250 else w for i, w in enumerate(long.split()))]
    row = {r["doc_id"]: r for r in syncmers.fingerprints(documents(spark, texts)).collect()}[1]
    a, b = (set(r["f"].split()) for r in documents(spark, texts).orderBy("doc_id").select(syncmers.fingerprint(F.col("text")).alias("f")).collect())
    assert 1300 < len(a) < 1700 and 0.95 < len(a & b) / len(a | b) < 1
    assert math.isclose(row["near_next"], len(a & b) / len(a | b), rel_tol=1e-9)


def test_fingerprints_of_short_and_unspaced_texts(spark):
    short = [" ".join(f"w{i}x{j}" for j in range(5 + i % 3)) for i in range(30)]
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(documents(spark, short)).collect()}
    assert all(r["fingerprint"] and r["near_next"] < 0.2 for r in rows.values())
    r = random.Random(11)
    line = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(4000))
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(documents(spark, [line, "新" + line, "".join(reversed(line))])).collect()}
    assert rows[1]["near_next"] > 0.9 and rows[2]["near_next"] < 0.05


def test_likeness_against_brute_force(spark):
    r = random.Random(12)
    base = prose(60, 300).split()
    texts = []
    for _ in range(25):
        w = list(base)
        for _ in range(r.randrange(0, 40)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        at = r.randrange(300)
        texts.append(" ".join(w[at:] + w[:at]) if r.random() < 0.3 else " ".join(w))
    rows = {x["doc_id"]: x for x in syncmers.fingerprints(documents(spark, texts)).collect()}

    def like(x, y):
        x, y = x.split(), y.split()
        both = set(x) & set(y)
        if not both:
            return 0.0
        at = [y.index(h) for h in x if h in both]
        order = sum(q > p for p, q in zip([y_ for y_ in at], at[1:])) / (len(at) - 1) if len(at) > 1 else 1.0
        follow = [h for h in x if h in both]
        return len(both) / len(set(x) | set(y)) * (order if follow else 1.0)

    for i in rows:
        nxt = rows[i - 1 if i else len(texts) - 1]
        assert math.isclose(rows[i]["near_next"], like(rows[i]["fingerprint"], nxt["fingerprint"]), abs_tol=1e-9)
        assert math.isclose(rows[i]["near_edited"], like(rows[i]["fingerprint"], rows[i]["edited_fingerprint"]), abs_tol=1e-9)


def test_fingerprint_edges(spark):
    assert syncmers.fingerprints(odd(spark)).count() == len(EDGES) + 3
    assert syncmers.fingerprints(odd(spark).limit(0)).count() == 0
    assert syncmers.fingerprints(odd(spark).limit(1)).first()["near_next"] == 1.0


# -- 7


def test_url_rules_and_trees(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/1?x=1", "https://example.org/en/12#t", "https://example.org/en/2", "http://x.com/fr/1", "http://com/de/", "http://y.net/fr/1",
        "http://notexample.org/es/", "http://org", "https://xorg/es/", "ftp://q.org?x=/es/", "http://b.example.org/es",
    ]
    urls += [f"http://www.site{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(300)] + [f"http://m.other{i}.net/{'fr' if i % 2 else 'de'}/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("id", F.lit("x"))
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        low = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (got[i]["host"], got[i]["path"]) == (low, path)
        fits = [(len(h + p), h + p, k) for k, h, p in url_filter.RULES if (low == h or low.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        assert got[i]["rule"] == rule[0]
        assert got[i]["verdict"] == rule[1] if rule[1] else got[i]["verdict"] in ("allow", "block")
        assert 0 <= got[i]["score"] <= 1
    assert url_filter.judge(pages.limit(0)).count() == 0 and url_filter.judge(pages.limit(3)).count() == 3


def grown(x, g, h, cuts, depth):
    """One tree by trying every cut of every feature in every leaf."""
    value = -g.sum() / (h.sum() + url_filter.SMOOTH)
    best, at = 1e-6, None
    for f, name in enumerate(url_filter.FEATURES) if depth else ():
        for cut in cuts[name]:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < url_filter.LEAST:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + url_filter.SMOOTH) for m in (low, ~low)) - g.sum() ** 2 / (h.sum() + url_filter.SMOOTH)
            if gain > best * (1 + 1e-9):
                best, at = gain, (name, cut, low)
    if not at:
        return url_filter.RATE * value
    name, cut, low = at
    return url_filter.Split(name, cut, *(grown(x[m], g[m], h[m], cuts, depth - 1) for m in (low, ~low)))


def same_tree(a, b):
    if not isinstance(a, url_filter.Split) or not isinstance(b, url_filter.Split):
        return not isinstance(a, url_filter.Split) and not isinstance(b, url_filter.Split) and abs(a - b) < 1e-9
    return (a.feature, a.cut) == (b.feature, b.cut) and same_tree(a.low, b.low) and same_tree(a.high, b.high)


def test_a_tree_equals_trying_all_cuts(spark):
    r = np.random.default_rng(6)
    x = r.integers(0, 9, (400, len(url_filter.FEATURES))).astype(float)
    y = ((x[:, 2] > 4) ^ (x[:, 5] + r.normal(0, 1, 400) > 6)).astype(float)
    cuts = {f: [1.0, 3.0, 4.0, 6.0] for f in url_filter.FEATURES}
    sample = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "y double, " + ", ".join(f"{f} double" for f in url_filter.FEATURES))
    margin = 0.3
    p = 1 / (1 + np.exp(-margin))
    got = url_filter.grow(sample, cuts, F.lit(margin))
    assert isinstance(got, url_filter.Split) and same_tree(got, grown(x, p - y, np.full(400, p * (1 - p)), cuts, url_filter.DEPTH))
    scores = sample.select(url_filter.as_column(got).alias("s")).collect()

    def value(node, row):
        while isinstance(node, url_filter.Split):
            node = node.low if row[url_filter.FEATURES.index(node.feature)] <= node.cut else node.high
        return node

    assert all(abs(s["s"] - value(got, row)) < 1e-12 for s, row in zip(scores, x))


def test_url_suffixes_of_all_labels(spark, monkeypatch):
    urls = [f"http://a{i}.{'bad' if i % 2 else 'good'}.{'de' if i % 2 else 'fr'}.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(200)] + [f"http://z{i}.net/q" for i in range(50)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    few = {r["page_id"]: r["score"] for r in url_filter.judge(pages).collect()}
    monkeypatch.setattr(url_filter, "FEW_SUFFIXES", 0)  # the way for many suffixes
    assert few == {r["page_id"]: r["score"] for r in url_filter.judge(pages).collect()}


# -- 8


def test_licence_places(spark):
    texts = [
        "Released under the MIT License.", "GNU General\nPublic-License, and again gnu general public license v3", "cc by; CC-BY! cc  by", "mit licenses apache", None, "",
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
        prose(3, 100) + " Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "straße mit license ÉCOLE", "the license was red and the public is free to use this file",
    ]
    got = {r["doc_id"]: r for r in licence_scan.scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in licence_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None)), t
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "cc-by-nc" in got[6]["labels"] and "gpl-3.0" in got[7]["labels"] and "gpl-2.0" not in got[7]["labels"] and "apache-2.0" in got[8]["labels"]
    assert got[9]["labels"] == "bsd" and got[11]["labels"] == "" and got[3]["labels"] == ""
    assert licence_scan.scan(odd(spark)).count() == len(EDGES) + 3 and licence_scan.scan(odd(spark).limit(0)).count() == 0


def test_licences_of_long_texts(spark):
    notices = [text for _, text, _ in licence_scan.TEMPLATES]
    texts = ["\n" + (" " + prose(4, 20) + " ").join(notices), *notices]
    texts += ["the mit license"] * 200  # its words are common
    got = {r["doc_id"]: r for r in licence_scan.scan(documents(spark, texts)).collect()}
    every = {label for label, _, _ in licence_scan.TEMPLATES}
    assert every <= set(got[0]["labels"].split(","))
    assert all(label in got[i]["labels"].split(",") for i, (label, _, _) in enumerate(licence_scan.TEMPLATES, 1))


def test_edited_whole_licences(spark):
    texts = []
    for i, (_, text, keys) in enumerate(licence_scan.WHOLE):
        w, fixed = text.split(), {x for k in keys for x in k.split()}
        r = random.Random(i)
        for _ in range(len(w) // 30):  # words left out or put in outside of the key phrases
            k = r.choice([k for k in range(len(w) - 1) if not fixed & {w[k], w[k + 1]}])
            w[k : k + 1] = [w[k], "indeed"] if r.random() < 0.5 else []
        texts.append(prose(i, 200) + "\n" + " ".join(w) + "\n" + prose(900 + i, 50))
    got = {r["doc_id"]: r["labels"].split(",") for r in licence_scan.scan(documents(spark, texts + [prose(i, 80) for i in range(100)])).collect()}
    assert sum(label in got[i] for i, (label, _, _) in enumerate(licence_scan.WHOLE)) >= len(licence_scan.WHOLE) - 1
    assert all(got[i] == [""] for i in range(len(texts), len(texts) + 100))


# -- 9


def language_docs(spark):
    r = random.Random(8)
    sets = {"aa": ["ka", "ki", "ko", "kut"], "bb": ["lum", "lor", "li", "la"], "cc": ["zé", "zöp", "zu"]}
    texts, langs = [], {}
    for i in range(240):
        lang = sorted(sets)[i % 3]
        texts.append(" ".join("".join(r.choice(sets[lang]) for _ in range(r.randrange(1, 4))) for _ in range(60)))
        langs[i] = lang
    return texts, langs


def test_language_models_and_held_out_accuracy(spark):
    texts, langs = language_docs(spark)
    docs = documents(spark, [*texts, None, "123 !!", "東京は日本の首都です 東京は日本の首都です " * 10], langs | {240: None, 241: "aa", 242: None})
    rows = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    out = [i for i in langs if rows[i]["held_out"] and i < 240]
    assert len(out) > 30 and all(rows[i]["lang_pred"] == langs[i] for i in out)
    assert rows[240]["lang_pred"] == rows[241]["lang_pred"] == "und" and rows[240]["rejected"] and rows[242]["rejected"]
    assert not any(rows[i]["rejected"] for i in range(240)) and all(0 <= r["score"] <= 1 for r in rows.values())
    kept = language_id.drop_rejected(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(240))


def gram_counts():
    r = random.Random(2)
    return Counter(("xx" if i % 3 else "yy", "".join(r.choice("ab ") for _ in range(5))) for i in range(400))


def gram_table(counts):
    return pa.table({"lang": [a for a, _ in counts], "gram": [g for _, g in counts], "n": list(counts.values())})


def test_kneser_ney_against_plain_recursion():
    counts = gram_counts()
    models = language_id.kneser_ney(gram_table(counts))
    for k, lang in enumerate(("xx", "yy")):
        levels = {5: Counter({g: n for (a, g), n in counts.items() if a == lang})}
        for n in range(4, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])

        def p(gram):
            if not gram:
                return 1.0 / language_id.FLOOR_CHARS
            c = levels[len(gram)]
            ones, twos = (sum(n == x for n in c.values()) for x in (1, 2))
            d = min(max(ones / (ones + 2 * twos) if ones + 2 * twos else 0.5, 0.1), 0.9)
            same = [n for g, n in c.items() if g[:-1] == gram[:-1]]
            return (max(c[gram] - d, 0) + d * len(same) * p(gram[1:])) / sum(same) if same else p(gram[1:])

        grams = ["".join(random.Random(i).choice("ab c") for _ in range(5)) for i in range(200)]
        got = models.score(np.array([[ord(x) for x in g] for g in grams]))[:, k]
        assert np.allclose(got, [math.log(p(g)) for g in grams], atol=1e-4)


def test_rare_languages_teach_and_own_arrays_equal_the_shared_table(spark, monkeypatch):
    texts, langs = language_docs(spark)
    texts += ["xyq xyq qyx wqx"] * 2
    docs = documents(spark, texts, langs | {240: "rare", 241: "rare"})
    rows = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert rows[240]["lang_pred"] == "rare" == rows[241]["lang_pred"]
    monkeypatch.setattr(language_id, "CELLS", 0)  # each language by itself
    assert language_id.fit(docs).own
    again = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for i, r in rows.items():
        assert r["lang_pred"] == again[i]["lang_pred"] and r["rejected"] == again[i]["rejected"] and abs(r["loss"] - again[i]["loss"]) < 1e-4
    # many languages: none loses its grams
    monkeypatch.undo()
    r = random.Random(4)
    roots = {f"l{n:03d}": [chr(0x4E00 + n * 12 + j) for j in range(12)] for n in range(100)}
    many = [(i, " ".join("".join(r.choice(roots[lang]) for _ in range(4)) for _ in range(30)), lang, "s", None) for i, lang in enumerate(sorted(roots) * 6)]
    monkeypatch.setattr(language_id, "CELLS", 100_000)
    models = language_id.fit(spark.createDataFrame(many, DOC))
    assert len(models.own) == 100 and models.score(np.array([[32, 32, 32, 32, ord("x")]])).shape == (1, 100)
    best, _, _, _ = language_id.decide(models, pa.array([m[1] for m in many]))
    assert sum(models.languages[b] == m[2] for b, m in zip(best, many, strict=True)) == len(many)


def test_kneser_ney_sums_to_one():
    models = language_id.kneser_ney(gram_table(gram_counts()))
    for context in ("    ", "a ba", "zzzz", "bbbb", "zzab"):
        grid = np.array([[ord(c) for c in context + x] for x in "ab "])
        p = np.exp(models.score(grid).astype(float)).sum(0)
        other = (language_id.FLOOR_CHARS - 3) * np.exp(models.score(np.array([[ord(c) for c in context + "q"]])).astype(float))[0]
        assert np.allclose(p + other, 1, atol=1e-4), context


def test_language_edges(spark):
    assert language_id.identify(odd(spark)).count() == len(EDGES) + 3
    none = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(none).collect()} == {"und"}
    assert language_id.identify(odd(spark).limit(0)).count() == 0
    assert language_id.drop_rejected(odd(spark)).columns == odd(spark).columns


# -- 10


def bag(text):
    w = (text or "").lower().split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    return Counter({g: n.bit_length() for g, n in Counter(grams).items()})


def brute_classes(texts):
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("hot", [2000, 30, 0])  # buckets meet their facts by broadcast, in part, or by key
def test_near_duplicates_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(dart_minhash, "TILE", 8)
    monkeypatch.setattr(common, "HOT", hot)
    base = [prose(i, 120) for i in range(10)]
    r = random.Random(6)
    texts = []
    for i in range(160):
        w = base[i % 10].split()
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [prose(500 + i, 50) for i in range(30)] + ["hi there", "hi there", None, "", "", "again " * 400, "again " * 500]
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_darts_estimate_similarity():
    a = pa.array([" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(100, 500)), "one", " ".join(f"w{i}" for i in range(400))])
    offsets, cell = dart_minhash.cells(a, 1, "set")
    sig = dart_minhash.dart_signatures(offsets, cell, 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.05 and (sig[0] == sig[3]).all() and (sig[2] != 0).all() and (sig[0] == sig[2]).mean() < 0.01


def test_near_duplicates_edges(spark):
    rows = dart_minhash.near_duplicates(odd(spark)).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11}
    kept = dart_minhash.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("doc_id is null").count() == 1
    assert dart_minhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_ids_that_are_texts(spark):
    texts = [prose(1, 60), prose(2, 60), prose(1, 60), None, edited(prose(2, 60), 60), prose(1, 60), "lost"]
    names = ["m", "zz", "é", "k", "b-1", "m", None]
    docs = spark.createDataFrame(list(zip(names, texts, strict=True)), "doc_id string, text string")
    found = {tuple(r) for r in dart_minhash.near_duplicates(docs).collect()}
    assert found == {("m", "m", True), ("é", "m", False), ("k", "k", True), ("b-1", "b-1", True), ("zz", "b-1", False)}
    assert sorted(str(r["doc_id"]) for r in dart_minhash.drop_near_duplicates(docs).collect()) == ["None", "b-1", "k", "m", "m"]
    as_numbers = docs.where("doc_id is null or doc_id <> 'm'").withColumn("doc_id", F.expr("CASE doc_id WHEN 'b-1' THEN 1 WHEN 'k' THEN 2 WHEN 'zz' THEN 3 WHEN 'é' THEN 4 END"))
    prints = lambda df: sorted(str(tuple(r)[1:]) for r in syncmers.fingerprints(df).collect())
    assert prints(docs.where("doc_id is null or doc_id <> 'm'")) == prints(as_numbers)
    assert {r["doc_id"] for r in syncmers.fingerprints(docs).collect()} == set(names)
    assert syncmers.fingerprints(docs.limit(0)).count() == dart_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    shared = prose(900, 90)
    texts = [prose(i, 80 + i % 50) for i in range(120)]
    texts[7] = texts[6]
    texts[11] = edited(texts[10], 60)
    texts[20] += " " + shared
    texts[31] = prose(31, 60) + " " + shared + " " + prose(77, 60)
    docs = documents(spark, [*texts, None, "123 456"])
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if n < 4:
            assert out.columns == docs.columns, name
        rows = out.collect()
        ids = {r["doc_id"] for r in rows}
        if name == "language_id":
            assert ids == set(range(120))
        if name == "minhash_near_dedup":
            assert ids == set(range(120)) - {7, 11}
        if name == "substring_dedup":
            assert next(r["text"] for r in rows if r["doc_id"] == 31) == prose(31, 60) + " " + prose(77, 60)
        if name == "sentencepiece":
            assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
        docs = spark.createDataFrame(rows, out.schema)

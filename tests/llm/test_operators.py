from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwell.llm import class_lm, components, embedding_dedup, html_extract, importance, language_id, mixing, ngram_join, packing, quality_rules, sharding

from .common import awkward, sentence, table, words


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_rule_counts_match_brute_force(spark):
    docs = awkward()
    docs.append((900, "a b c a b c d\nx\nx\n\n \nx y", "aa", "s1", 1, "", "", 1, 1, ""))
    docs.append((901, "q q q q", "aa", "s1", 1, "", "", 1, 1, ""))
    out = {(r["doc_id"], r["n_words"]): r for r in rows_of(quality_rules.judge(table(spark, docs)))}
    for doc_id, text, *_ in docs:
        w = words(text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p + d for p, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[g] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = out[(doc_id, len(w))]
        assert (r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_host_rates_shrink_toward_the_prior(spark):
    rows = [("a", i < 9) for i in range(10)] + [("b", False)] * 10 + [("c", True)] + [(None, False)] * 5
    out = {r["host"]: r for r in rows_of(quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, soft_failed boolean")))}
    raw = [0.9, 0.0, 1.0, 0.0]
    a, b = quality_rules.beta_prior(float(np.mean(raw)), float(np.var(raw)))
    assert out["c"]["host_rate"] == pytest.approx((1 + a) / (1 + a + b)) and out["c"]["host_rate"] < 1
    assert out["a"]["host_bad"] and not out["b"]["host_bad"] and not out[None]["host_bad"]
    assert quality_rules.beta_prior(None, None) == (1.0, 1.0)


def test_rules_keep_all_columns_and_repeats(spark):
    docs = table(spark)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 7").count() == 3
    assert quality_rules.filter_documents(docs.limit(0)).count() == 0


def test_filters_keep_what_is_judged_kept(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    for verdicts, kept in ((quality_rules.judge(docs), quality_rules.filter_documents(docs)), (importance.resample(docs, labels, k=30), importance.resample(docs, labels, k=30))):
        if "text" not in kept.columns:
            from maskwell.llm.common import only_kept

            kept = only_kept(docs, verdicts)
        want = {(r["doc_id"], r["text_hash"]) for r in rows_of(verdicts) if r["kept"]}
        rows = [(r["doc_id"], r["h"]) for r in rows_of(docs.withColumn("h", F.xxhash64("text")))]
        got = Counter((r["doc_id"], r["h"]) for r in rows_of(kept.withColumn("h", F.xxhash64("text"))))
        assert got == Counter(r for r in rows if r in want) and kept.columns == docs.columns and 0 < len(got) < len(set(rows))


def test_importance_keeps_the_target_and_drops_the_rest(spark):
    import random

    rng = random.Random(5)
    lexicon = sentence(rng, "aa", 120).split()
    draw = lambda: [rng.choice(lexicon) for _ in range(80)]
    good = [(i, " ".join(draw())) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}###" for w in draw())) for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in rows_of(importance.resample(docs, labels))}
    assert all(out[i]["kept"] for i in range(0, 300, 2)) and sum(out[i]["kept"] for i, _ in good) >= 294 and sum(out[i]["kept"] for i, _ in bad) == 0
    again = {r["doc_id"]: r for r in rows_of(importance.resample(docs, labels))}
    assert again == out
    assert sum(r["kept"] for r in rows_of(importance.resample(docs, labels, k=100))) == 100
    assert all(r["kept"] for r in rows_of(importance.resample(docs, labels.limit(0))))
    assert importance.filter_documents(docs.limit(0), labels).count() == 0


def test_importance_weights_match_brute_force(spark):
    docs = [r[:2] for r in awkward()]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("role", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(50)], "doc_id long, quality int")
    out = Counter((r["doc_id"], r["n_ngrams"], round(r["log_weight"], 9), round(r["gumbel_key"], 9), r["kept"]) for r in rows_of(importance.resample(df, labels, buckets=512)))
    roles = {r["i"]: 2 if r["h"] == 0 else 1 for r in rows_of(spark.createDataFrame([(i,) for i in range(50) if i % 4], "i long").select("i", F.pmod(F.xxhash64("i", F.lit(12)), F.lit(5)).alias("h")))}

    def grams(text):
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(text)]
        one = lambda w: np.frombuffer(w.encode(), np.uint8)
        hashes = [importance.hash_words(one(w), np.asarray([0]), np.asarray([len(one(w))])) for w in low]
        return [int(h[0] % np.uint64(512)) for h in hashes] + [int(importance.mix(a * np.uint64(3) + b)[0] % np.uint64(512)) for a, b in zip(hashes, hashes[1:], strict=False)]

    held = [grams(text) for _, text in docs]
    raw, target = Counter(g for x in held for g in x), Counter(g for (i, _), x in zip(docs, held, strict=True) if roles.get(i) == 1 for g in x)
    ratio = [math.log((target[g] + 1) / (sum(target.values()) + 512)) - math.log((raw[g] + 1) / (sum(raw.values()) + 512)) for g in range(512)]
    weight = [sum(ratio[g] for g in x) / (1 + 0.01 * max(0, len(x) - 1)) for x in held]
    keys = [w - math.log(-math.log(float(importance.unit_interval(importance.hash_keys(np.asarray([-1 if i is None else i]), 11))[0]))) for w, (i, _) in zip(weight, docs, strict=True)]
    calibration = [w for w, (i, _), x in zip(weight, docs, held, strict=True) if roles.get(i) == 2 and x]
    if len(calibration) < 8:
        fitted = [w for w, (i, _), x in zip(weight, docs, held, strict=True) if roles.get(i) == 1 and x]
        cut = min(min(v) - float(np.std(v)) for v in (calibration, fitted) if v)
    else:
        cut = min(calibration) - float(np.std(calibration))
    k = sum(w >= cut for w in weight)
    limit = sorted(keys, reverse=True)[k - 1]
    assert out == Counter((i, len(x), round(w, 9), round(g, 9), g >= limit) for (i, _), x, w, g in zip(docs, held, weight, keys, strict=True))


def test_ngram_counts_are_whole(spark):
    docs = table(spark).select("text", F.lit(True).alias("is_target"))
    n = sum(r["raw"] for r in rows_of(importance.count_ngrams(docs, 64)))
    assert n == sum(2 * len(w) - (len(w) > 0) for w in (words(r[1]) for r in awkward()))


@pytest.mark.parametrize("k", [1, 7, 500, 1000, 2000])
def test_kth_largest_is_exact(spark, k):
    values = [round(math.sin(i) * 100, 1) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, 1000) - 1]


def test_packing_is_an_exact_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = [r[:2] for r in awkward() if r[0] is not None and r[0] != 7] + [(800, "it's we'll x  \n\n y 12'3 <|endoftext|> \U0001f600")]
    pieces = packing.token_pieces(spark.createDataFrame(docs, "doc_id long, text string"), with_ids=True)
    out = rows_of(packing.pack(pieces, group_rows=40))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [i for p in parts for i in p["ids"]] == ids
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert all(p["ids_crc32"] == zlib.crc32(np.asarray(p["ids"], "<u4").tobytes()) for p in parts)
        assert len(parts) == max(1, -(-len(ids) // 1024))
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack_documents(table(spark).limit(0)).count() == 0
    assert packing.pack_documents(table(spark)).select("doc_id").filter("doc_id = 7").count() == 3


def test_sum_of_squares_packs_tightly():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 1024, 3000))[::-1]
    bins, offsets = packing.sum_of_squares(lengths)
    used = np.bincount(bins, lengths)
    assert used.max() <= 1024 and len(used) <= 1.01 * lengths.sum() / 1024 + 1
    order = np.lexsort((offsets, bins))
    begins = np.concatenate([[True], np.diff(bins[order]) > 0])
    assert (offsets[order][begins] == 0).all()


def test_class_scores_match_brute_force_base(spark):
    docs = [r for r in awkward() if r[0] is not None and r[0] != 7]
    out = {r["doc_id"]: r for r in rows_of(class_lm.class_scores(table(spark, docs)))}
    low = {r[0]: [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(r[1])), None] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in low}
    count = Counter(w for i, ws in low.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in low.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["score"] < 0
    assert class_lm.class_scores(table(spark).limit(0)).count() == 0
    assert class_lm.class_scores(table(spark)).count() == len(awkward())


def _word_hash(w):
    data = np.frombuffer(w.encode(), np.uint8)
    return int(class_lm.tokens(data, np.asarray([0, len(data)]))[0].view(np.int64)[0])


def _shape(w):
    data = np.frombuffer(w.encode(), np.uint8)
    return int(class_lm.tokens(data, np.asarray([0, len(data)]))[1][0])


def _brute_class_scores(docs, model, ids):
    """Scores from the definition, with the model's classes alone."""
    k = len(model.transition)
    of = lambda w: model.classes.of[ids.get(_word_hash(w), -1 - _shape(w))]
    learned = [text.split() for _, text, yes in docs if yes]
    count = Counter(w for ws in learned for w in ws)
    bigrams, into, kinds = np.zeros((k, k)), np.zeros(k), Counter(of(w) for w in count)
    for ws in learned:
        classes = [k - 1, *(of(w) for w in ws), k - 1]
        for a, b in zip(classes, classes[1:], strict=False):
            bigrams[a, b] += 1
            into[b] += 1
    share = (into + 1) / (into.sum() + k)
    out = {}
    for i, text, _ in docs:
        total, a = 0.0, k - 1
        for w in [*text.split(), None]:
            b = k - 1 if w is None else of(w)
            total += math.log10((bigrams[a, b] + 2 * share[b]) / (bigrams[a].sum() + 2))
            if w is not None:
                total += math.log10((count[w] + 0.1) / (into[b] + 0.1 * (kinds[b] + 1)))
            a = b
        out[i] = total
    return out


def test_class_model_is_a_distribution_and_beats_the_base(spark):
    import random

    rng = random.Random(1)
    text = {"aa": [sentence(rng, "aa", 1) for _ in range(50)], "bb": [sentence(rng, "bb", 1) for _ in range(50)]}
    docs = [(i, " ".join(rng.choice(text["aa" if i % 2 else "bb"]) for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = [r for r in rows_of(class_lm.class_scores(df)) if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    model, words_table, _ = class_lm.fit(df.withColumn("learned", F.lit(True)))
    k = len(model.transition)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    total = np.zeros(k)
    for r in rows_of(words_table):
        c = model.classes.of[r["id"]]
        total[c] += (r["n"] + class_lm.DELTA) / 10 ** model.emission_total[c]
    assert (total[: k - 1] <= 1 + 1e-9).all() and max(model.values) > model.values[0]


@pytest.mark.parametrize("head", [40, 4096, 0])
def test_class_scores_follow_from_the_classes(spark, monkeypatch, head):
    import random

    monkeypatch.setattr(class_lm, "HEAD_WORDS", head)
    rng = random.Random(3)
    first, second = ([f"{c}{i}xyz" for i in range(60)] for c in "ab")
    filler = [f"f{i}" for i in range(40)]
    docs = [(i, " ".join(f"{rng.choice(filler)} {rng.choice(first)} {rng.choice(second)}" for _ in range(20)) + (f" new{i}" if i % 9 == 0 else ""), i % 9 > 0) for i in range(150)]
    model, words_table, coded = class_lm.fit(spark.createDataFrame(docs, "doc_id long, text string, learned boolean"))
    rows = rows_of(words_table)
    count = Counter(w for _, text, yes in docs if yes for w in text.split())
    assert {r["word"]: r["n"] for r in rows} == {_word_hash(w): n for w, n in count.items()}
    ids = {r["word"]: r["id"] for r in rows}
    assert len(set(ids.values())) == len(ids)
    want = _brute_class_scores(docs, model, ids)
    got = {r["doc_id"]: r["score"] for r in rows_of(class_lm.score_texts(coded, model))}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    if head == 40:
        # Classes that are not broadcast give the same scores.
        monkeypatch.setattr(class_lm, "BROADCAST_WORDS", 1)
        again, _, texts = class_lm.fit(spark.createDataFrame(docs, "doc_id long, text string, learned boolean"))
        assert again.classes.limit < model.classes.limit and again.values == model.values and np.array_equal(again.classes.of[-class_lm.SHAPES :], model.classes.of[-class_lm.SHAPES :])
        assert {r["doc_id"]: r["score"] for r in rows_of(class_lm.score_texts(texts, again))} == got
        # Those that precede and those that follow the filler words are told apart, though all end alike and most move outside the head.
        of = {w: model.classes.of[ids[_word_hash(w)]] for w in [*first, *second] if _word_hash(w) in ids}
        (a, n_a), (b, n_b) = (Counter(of[w] for w in group if w in of).most_common(1)[0] for group in (first, second))
        assert a != b and min(n_a, n_b) > len(of) / 5


def test_relocation_is_the_best_single_move():
    rng = np.random.default_rng(11)
    k, n = 5, 30
    pairs = rng.integers(0, 3, (n, n)) * rng.integers(0, 2, (n, n))
    classes = np.append(rng.integers(0, k - 1, n - 1), k - 1)
    np.fill_diagonal(pairs, 0)

    def matrix(c):
        m = np.zeros((k, k))
        np.add.at(m, (c[:, None].repeat(n, 1), c[None, :].repeat(n, 0)), pairs)
        return m

    rule = class_lm.Relocation(matrix(classes))
    for u in range(n - 1):
        out, into = (np.bincount(classes, p, minlength=k) for p in (pairs[u], pairs[:, u]))
        if out[classes[u]] or into[classes[u]]:
            continue  # rated as if its own class stood still: not exact
        sides = [(np.flatnonzero(x), x[np.flatnonzero(x)].astype(np.int64)) for x in (out, into)]
        new = int(rule.best(np.asarray([classes[u]]), *sides)[0])
        value = lambda c: class_lm.likelihood(matrix(np.where(np.arange(n) == u, c, classes)))
        assert value(new) == pytest.approx(max(value(c) for c in range(k - 1)))
    once = rule.once()
    for after in range(k):
        for before in range(k):
            for own in range(k - 1):
                if rule.sides[0][0][own, after] > 0 and rule.sides[1][0][own, before] > 0:
                    one = np.asarray([1])
                    assert once[after, before, own] == rule.best(np.asarray([own]), (np.asarray([after]), one), (np.asarray([before]), one))[0]


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(4)
    n, k = 40, 5
    pairs = rng.integers(0, 30, (n, n)) * (rng.integers(0, 2, n)[:, None] == rng.integers(0, 2, n)[None, :])
    classes = np.append(rng.integers(0, k - 1, n - 1), k - 1)

    def matrix(c):
        m = np.zeros((k, k))
        np.add.at(m, (c[:, None].repeat(n, 1), c[None, :].repeat(n, 0)), pairs)
        return m

    def contexts(p, c):
        out = np.zeros((n, k))
        for x in range(k):
            out[:, x] = p[:, c == x].sum(axis=1)
        return out

    for u in range(n - 1):
        new = class_lm.exchange(classes, contexts(pairs, classes), contexts(pairs.T, classes), np.diagonal(pairs), np.asarray([u]))[0]
        best = max(class_lm.likelihood(matrix(np.where(np.arange(n) == u, c, classes))) for c in range(k - 1))
        assert class_lm.likelihood(matrix(new)) == pytest.approx(best)
        classes = new


def test_targets_fill_up_to_the_cap():
    sizes = [100, 50, 10, 1000, 0]
    out = mixing.targets(sizes)
    assert sum(out) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(out, sizes, strict=True))
    free = [(t, w) for t, s, w in zip(out, sizes, (5, 2, 1, 5, 2), strict=True) if t < 2 * s - 1e-9]
    assert len({round(t / w, 6) for t, w in free}) <= 1
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation_is_one(n):
    out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(out) == list(range(n))
    if n == 1000:
        assert (out != np.arange(n)).mean() > 0.9


def test_draws_end_at_the_slots(spark, monkeypatch):
    slots = {0: 10_000, 1: 0, 2: 37, 3: 5}
    df = spark.createDataFrame([(i, 99, n) for i, n in slots.items()], "source_index long, blocks long, slots long")
    for most in (1 << 22, 1000):
        monkeypatch.setattr(mixing, "DRAW_SLOTS", most)
        drawn = rows_of(mixing.draw_shards(df, 16, 7))
        for i, n in slots.items():
            runs_of = sorted((r["first"], r["n"]) for r in drawn if r["source_index"] == i)
            assert [a for a, _ in runs_of] == [sum(k for _, k in runs_of[:j]) for j in range(len(runs_of))] and sum(k for _, k in runs_of) == n
        hot = Counter()
        for r in drawn:
            if r["source_index"] == 0:
                hot[r["shard"]] += r["n"]
        assert len(hot) == 16 and all(abs(n - 625) < 6 * math.sqrt(625) for n in hot.values())
        assert sorted(map(str, drawn)) == sorted(map(str, rows_of(mixing.draw_shards(df, 16, 7))))


def test_source_targets_match_brute_force(spark):
    rows = [("b", 100), ("a", 5), (None, 40), ("é", 1000), ("a", 5), ("", 0), ("Z", 30), ("\U0001f600", 7), ("\uffff", 9)] + [(f"s{i:03}", i % 17) for i in range(200)]
    out = {r["source"]: r for r in rows_of(mixing.source_table(spark.createDataFrame(rows, "source string, size long")))}
    sizes = Counter()
    for k, n in rows:
        sizes[k] += n
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    want = mixing.targets([sizes[k] for k in order])
    assert [out[k]["source_index"] for k in order] == list(range(len(order)))
    assert [out[k]["target"] for k in order] == pytest.approx(want) and [out[k]["source_size"] for k in order] == [sizes[k] for k in order]
    assert mixing.source_table(spark.createDataFrame([], "source string, size long")).count() == 0


def test_taken_words_follow_from_the_slots(spark):
    docs = table(spark)
    rows, slots = mixing.plan_mix(docs)
    times = Counter((r["source_index"], r["block"]) for r in rows_of(slots))
    want = Counter()
    for r in rows_of(rows):
        want[(r["doc_id"], sum(times[(r["source_index"], w // mixing.BLOCK_WORDS)] for w in range(r["begin"], r["begin"] + r["size"])))] += 1
    assert Counter((r["doc_id"], r["taken"]) for r in rows_of(mixing.taken_words(docs))) == want
    assert all(k in (1, 2) for k in times.values())


def _mix(spark, docs):
    rows, slots = mixing.plan_mix(docs)
    times = slots.groupBy("source_index", "block").count()
    pieces = mixing.block_pieces(rows).join(times, ["source_index", "block"])
    return rows, pieces


def test_mix_comes_near_the_targets(spark):
    rows, pieces = _mix(spark, table(spark))
    size = {r["source"]: (r["s"], r["t"]) for r in rows_of(rows.groupBy("source").agg(F.sum("size").alias("s"), F.first("target").alias("t")))}
    taken = {r["source"]: r["k"] for r in rows_of(pieces.groupBy("source").agg(F.sum(F.col("n") * F.col("count")).alias("k")))}
    for source, (s, t) in size.items():
        assert abs(taken.get(source, 0) - t) <= mixing.BLOCK_WORDS and taken.get(source, 0) <= 2 * s
    expected = mixing.targets([s for _, (s, _) in sorted(size.items(), key=lambda x: (x[0] is None, x[0] or ""))])
    assert [t for _, (_, t) in sorted(size.items(), key=lambda x: (x[0] is None, x[0] or ""))] == pytest.approx(expected)
    over = pieces.groupBy("source_index", "begin", "size").agg(F.sum(F.col("n") * F.col("count")).alias("k")).filter("k > 2 * size").count()
    assert over == 0


def test_mixed_documents_hold_what_is_taken(spark):
    docs = table(spark)
    _, pieces = _mix(spark, docs)
    want = {r["doc_id"]: r["k"] for r in rows_of(pieces.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("count")).alias("k")))}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, texts = Counter(), defaultdict(str)
    for r in awkward():
        texts[r[0]] += "|" + (r[1] or "")
    for r in rows_of(mixed):
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert dict(got) == want
    assert sorted(map(str, rows_of(mixing.mixed_documents(docs)))) == sorted(map(str, rows_of(mixed)))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_interleaving_matches_brute_force(spark):
    import hashlib

    docs = table(spark)
    base = sharding.describe_documents(docs)
    out = rows_of(sharding.interleave(base, 8, ties=("doc_id", "text_crc32")))
    order = []
    for source, members in _grouped(rows_of(base), "source").items():
        name = lambda r: hashlib.md5("|".join(["interleave", "~" if r["doc_id"] is None else str(r["doc_id"]), str(r["text_crc32"])]).encode()).hexdigest()
        members.sort(key=name)
        order += [((2 * k + 1) / (2 * len(members)), source is None, source or "", name(r), r["doc_id"]) for k, r in enumerate(members)]
    order.sort(key=lambda x: x[:4])
    n = len(order)
    want = Counter()
    for at, x in enumerate(order):
        shard = at * 8 // n
        want[(x[4], shard, at - (shard * n + 7) // 8)] += 1
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in out) == want
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(counts[shard]))
        hot = sum(r["source"] == "hot" for r in out if r["shard"] == shard)
        assert abs(hot - counts[shard] * sum(r["source"] == "hot" for r in out) / n) <= 2
    assert sharding.interleave(base.limit(0), 8).count() == 0
    clash = base.withColumn("rank", F.lit("r")).withColumn("group_rows", F.lit("g")).withColumn("_at", F.lit("a")).withColumn("_hash", F.lit("h"))
    again = rows_of(sharding.interleave(clash, 8, ties=("doc_id", "text_crc32")))
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in again) == want and {(r["rank"], r["group_rows"], r["_at"], r["_hash"]) for r in again} == {("r", "g", "a", "h")}
    with pytest.raises(ValueError):
        sharding.interleave(base.withColumn("slot", F.lit(1)), 8)


def _grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def _brute_join(docs, threshold=0.8):
    def grams(text):
        w = words(text)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = {k: grams(t) for k, t in enumerate(t for _, t in docs)}
    links, parent = Counter(), list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and docs[a][0] is not None and docs[b][0] is not None and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        classes[find(k)].append(i)
    return [(i, links[k], i if i is None else min(x for x in classes[find(k)] if x is not None)) for k, (i, _) in enumerate(docs)]


def test_join_matches_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(8)
    docs = [r[:2] for r in awkward()]
    group = sentence(rng, "bb", 90).split(" ")
    for i in range(70):
        copy = list(group)
        for _ in range(i % 4):
            copy[rng.randrange(90)] = f"w{i}"
        docs.append((2000 + i, " ".join(copy)))
    want = Counter(_brute_join(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk in (256, 8):
        monkeypatch.setattr(ngram_join.meetings, "__defaults__", (chunk,))
        out = rows_of(ngram_join.similar_documents(df))
        assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in out) == want
        assert all(r["kept"] == (r["doc_id"] == r["class_id"]) or r["doc_id"] is None for r in out)


def test_rows_with_one_id_are_documents_of_their_own(spark):
    import random

    rng = random.Random(21)
    a, b = (sentence(rng, lang, 90) for lang in ("aa", "bb"))
    docs = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (1, b), (4, None), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("rep", F.lit("r"))
    out = Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in rows_of(ngram_join.similar_documents(df)))
    assert out == Counter(_brute_join(docs)) and out[(1, 1, 1)] == 1 and out[(3, 2, 1)] == 1
    kept = sorted((r["doc_id"], r["text"] or "") for r in rows_of(ngram_join.filter_documents(df)))
    assert kept == sorted([(1, a), (1, b), (4, ""), (4, "")])


def test_join_filter_keeps_one_of_each_class(spark):
    docs = table(spark)
    kept = ngram_join.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in rows_of(kept)]
    want = {c for i, _, c in _brute_join([r[:2] for r in awkward()]) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert ngram_join.filter_documents(docs.limit(0)).count() == 0


def test_id_filter_passes_all_wanted_and_few_others(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    ids = spark.createDataFrame([(i,) for i in range(0, 20_000, 100)], "doc long")
    out = {r["doc_id"] for r in rows_of(ngram_join.only_ids(docs, ids))}
    assert out >= set(range(0, 20_000, 100)) and len(out) <= 205
    assert ngram_join.only_ids(docs, ids.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MOST_HASHES


def test_scratch_tables_go_when_asked(spark):
    import os

    from maskwell.llm.common import cleanup, discard, materialize

    one, two = (materialize(spark.range(5), "numbers") for _ in range(2))
    assert one.count() == 5
    discard(one)
    assert not os.path.exists(one._scratch_path) and os.path.exists(two._scratch_path)
    cleanup(spark)
    assert not os.path.exists(two._scratch_path)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 200), (300, 299), (299, 300)]
    out = {r["node"]: r["component"] for r in rows_of(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert all(out[i] == 0 for i in range(41)) and all(out[x] == 100 for x in range(100, 140)) and out[300] == 299 == out[299]


def test_languages_are_told_apart_on_held_out_texts(spark):
    import random

    rng = random.Random(9)
    rows = [(i, sentence(rng, "aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 34 ##", "bb"), (None, sentence(rng, "aa", 9), "aa"), (1003, sentence(rng, "bb", 5000), None), (1004, "\x00\x00", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.learn(df.filter(language_id.fold(F.col("doc_id"), 5) != 0))
    out = {r["doc_id"]: r for r in rows_of(language_id.identify(df, models))}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(out[i]["lang_pred"] == ("aa" if i % 2 else "bb") and 0.5 < out[i]["score"] <= 1 for i in held)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1000, 1001, 1002, 1004)) and out[1003]["lang_pred"] == "bb"
    nothing = language_id.learn(df.filter("lang = 'zz'"))
    assert {r["lang_pred"] for r in rows_of(language_id.identify(df, nothing))} == {"und"}
    assert language_id.identify(df.limit(0), models).count() == 0


def test_kneser_ney_sums_to_one():
    model = language_id.KneserNey(["abracadabra abra cadabra", "banana"], order=3, floor=1 / 7)
    alphabet = "abrcdn "  # all codes that occur: with the uniform floor over them each context has a distribution
    for context in ("ab", "an", "zz"):
        codes = [np.asarray([ord(c) for c in context + x], np.uint64) for x in alphabet]
        keys = [np.asarray([language_id.grams(c, n)[-1] for c in codes]) for n in (1, 2, 3)]
        heads = [np.zeros(len(codes), np.uint64)] + [np.asarray([language_id.grams(c[:-1], n)[-1] for c in codes]) for n in (1, 2)]
        assert np.exp(model.log_probability(keys, heads)).sum() == pytest.approx(1, abs=1e-6)


def test_entropies_match_brute_force():
    texts = {"aa": ["Abra, cadabra!", "banana abra", "raba"], "bb": ["zoz mozo", "om zom. oz"]}
    models = language_id.LanguageModels(texts, {}, order=3)

    def norm(t):
        out = []
        for c in t.lower():
            if c.isalpha():
                out.append(c)
            elif out and out[-1] != " ":
                out.append(" ")
        return "   " + "".join(out)

    def model(name):
        lines = [norm(t) for t in texts[name]]
        top = Counter(x[i - 2 : i + 1] for x in lines for i in range(3, len(x)))
        table = {3: top}
        for n in (2, 1):
            # An n-gram counts once for each different code before it.
            table[n] = Counter(g[1:] for g in table[n + 1]) if n < 2 else Counter(g[1:] for g in top)
        return table

    def probability(table, text, i):
        p = 1e-6
        for n in (1, 2, 3):
            counts, gram = table[n], text[i - n + 1 : i + 1]
            context = gram[:-1]
            ones, twos = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            inside = {g: v for g, v in counts.items() if g[:-1] == context}
            if inside:
                total = sum(inside.values())
                p = max(counts.get(gram, 0) - d, 0) / total + d * len(inside) / total * p
        return p

    asked = ["abra zoz", "Banana!", "q", "", "..a"]
    entropy, n = models.entropies(asked)
    for row, text in enumerate(asked):
        x = norm(text)
        assert n[row] == (len(x) - 3 if x.strip() else 0)
        for k, name in enumerate(models.names):
            want = [-math.log(probability(model(name), x, i)) for i in range(3, len(x))]
            assert entropy[row, k] == pytest.approx(sum(want) / max(1, len(want)))


def test_foreign_texts_are_rejected(spark):
    import random

    rng = random.Random(17)
    rows = [(i, sentence(rng, "aa" if i % 2 else "bb", rng.randint(3, 60)), "aa" if i % 2 else "bb") for i in range(600)]
    other = [(1000 + i, " ".join("".join(rng.choice("\u0430\u0431\u0432\u0433\u0434\u0435") for _ in range(5)) for _ in range(3 + i)), None) for i in range(30)]
    df = spark.createDataFrame(rows + other, "doc_id long, text string, lang string")
    models = language_id.learn(df.filter(language_id.fold(F.col("doc_id"), 5) != 0))
    out = {r["doc_id"]: r for r in rows_of(language_id.identify(df, models))}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["rejected"] and out[i]["score"] < 0.1 and out[i]["lang_pred"] in ("aa", "bb") for i, *_ in other)
    assert sum(out[i]["rejected"] for i in held) <= len(held) / 50 and sum(out[i]["score"] > 0.9 for i in held) > 0.9 * len(held)


@pytest.mark.parametrize("interval_rows", [65536, 40])
def test_vector_links_match_brute_force(spark, interval_rows):
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            center = rng.normal(size=8)
            for _ in range(9):
                rows.append((n, (center + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(20)]
    n += 20
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [1.0, None] + [0.0] * 6, 0), (n + 3, [float("nan")] + [1.0] * 7, 0), (n + 4, [float("inf")] + [1.0] * 7, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 0)]
    out = {r["vec_id"]: r for r in rows_of(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), interval_rows=interval_rows, block_rows=16))}
    links, parent = Counter(), {r[0]: r[0] for r in rows}
    good = {i: np.asarray(v, np.float64) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / math.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sum(links.values()) > 200
    for i in parent:
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (links[i], find(i), find(i) == i)
    assert embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").limit(0)).count() == 0


def test_vectors_are_known_by_themselves(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (None, [1.0, 0.0, 0.01], 0), (None, [1.0, 0.0, 0.01], 0), (-5, [0.0, 0.0, 1.0], 0)]
    for element in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, label int").withColumn("point", F.lit("x")).withColumn("ok", F.lit(1))
        out = sorted(tuple(r.values()) for r in rows_of(embedding_dedup.near_duplicates(df)) if r["vec_id"] is not None)
        assert out == [(-5, 0, -5, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
        assert [tuple(r.values()) for r in rows_of(embedding_dedup.near_duplicates(df)) if r["vec_id"] is None] == [(None, 0, None, True)] * 2


def test_skipped_blocks_hold_no_pair():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(200, 3))
    points = points[np.lexsort(points.T[::-1])]
    boxes = tuple(np.stack([f(points[i : i + 8], axis=0) for i in range(0, 200, 8)]) for f in (np.min, np.max))
    near = {(i // 8, j // 8) for i in range(200) for j in range(200) if np.linalg.norm(points[i] - points[j]) <= 0.3}
    found = list(embedding_dedup.near_pairs(boxes, boxes, True, 0.3))
    assert {(min(p), max(p)) for p in near} <= set(found) and len(found) == len(set(found)) < 325
    half = tuple(x[:10] for x in boxes), tuple(x[10:] for x in boxes)
    assert {(i, j - 10) for i, j in near if i < 10 <= j} <= set(embedding_dedup.near_pairs(*half, False, 0.3))


def test_vectors_of_a_label_are_moved_as_often_however_many(spark, capsys):
    rng = np.random.default_rng(14)
    moved = {}
    for n in (500, 5000):
        x = rng.normal(size=(2 * n, 16)).astype(np.float32)
        rows = spark.createDataFrame([(i, 1, str(i % 2), 16, v.tolist()) for i, v in enumerate(x)], "point long, copies long, label string, width int, embedding array<float>")
        axes = embedding_dedup.principal_axes(rows, 8)
        intervals = embedding_dedup.grid_intervals(rows, axes, 0.2, 8, 6554, "float")
        sizes = {r["interval"]: r["n"] for r in rows_of(intervals.select("interval", (F.octet_length("points") / 8).cast("long").alias("n")))}
        pairs = rows_of(embedding_dedup.interval_pairs(intervals, 0.2, 8))
        moved[n] = sum(sizes[r["left"]] + sizes[r["right"]] for r in pairs) / (2 * n)
        print(f"{n} vectors a label: {len(sizes)} intervals, {len(pairs)} pairs, each vector moved {moved[n]} times for pairs")
        assert sum(sizes.values()) == 2 * n
    assert moved[5000] <= moved[500] + 0.3
    # Beyond an interval's size a label is cut, and pairs that may be near are moved.
    cut_up = embedding_dedup.grid_intervals(rows, axes, 0.2, 8, 1000, "float")
    assert cut_up.count() >= 10 and embedding_dedup.interval_pairs(cut_up, 0.2, 8).count() > 0


@pytest.mark.parametrize("top", [64, 2])
def test_interval_pairs_are_found_at_every_level(spark, top):
    rng = np.random.default_rng(12)
    low = np.sort(rng.random((60, 2)), axis=0)
    boxes = [(i, "s" if i % 3 else "t", *map(float, low[i]), *map(float, low[i] + 0.02)) for i in range(60)]
    table_of = spark.createDataFrame(boxes, "interval long, stratum string, lo0 double, lo1 double, hi0 double, hi1 double")
    found = {(r["left"], r["right"]) for r in rows_of(embedding_dedup.interval_pairs(table_of, 0.1, 2, 4, top))}
    want = set()
    for i in range(60):
        for j in range(i + 1, 60):
            gap = np.maximum(0, np.maximum(low[i] - low[j] - 0.02, low[j] - low[i] - 0.02))
            if boxes[i][1] == boxes[j][1] and (gap * gap).sum() <= 0.01:
                want.add((i, j))
    assert found == want and want


def test_labels_merge_across_blocks():
    rng = np.random.default_rng(13)
    hit = np.triu(rng.random((40, 40)) < 0.03, 1)
    merging = components.Merging(40)
    for i in range(0, 40, 10):
        for j in range(i, 40, 10):
            merging.link(hit[i : i + 10, j : j + 10], slice(i, i + 10), slice(j, j + 10))
    roots, both = merging.roots(), hit | hit.T
    reach = np.linalg.matrix_power((both | np.eye(40, dtype=bool)).astype(float), 40) > 0
    assert ((roots[:, None] == roots[None, :]) == reach).all()


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="x"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, sir.</div><!-- c --><div id="main"><article><header><h1>The &amp; title</h1></header>
<p>First   para,\n with <b>bold</b> and <a href="x">a link</a>, quite long enough to count.</p><p><i>Second<br>line</i>, &#233;t&eacute; &lt;x&gt;.<p>Third one, unclosed.
<div class="ad">Buy now, please.</div><ul><li>One item, kept.</li><li>Two</li></ul><form><p>Name, form text.</p><input></form></article>
<div class="comments"><p>A reader comment, long enough, with marks, and more, and more, and more.</p></div></div><aside>Side, bar.</aside><footer>&copy; foot, note.</footer></body></html>"""


def test_main_text_of_a_page():
    want = "The & title\nFirst para, with bold and a link, quite long enough to count.\nSecond line, été <x>.\nThird one, unclosed.\nOne item, kept.\nTwo"
    assert html_extract.extract(PAGE) == want
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    assert html_extract.extract("<div><p>Plain, text</p>tail &am") == "Plain, text\ntail &am"
    assert html_extract.extract("just < words & more") == "just < words & more"
    assert html_extract.extract('<div class="page has-sidebar"><div class="entry-header"><h1>Head</h1></div><p>Text, of it.</p><div id="sidebar">Bar, side.</div></div>') == "Head\nText, of it."
    assert html_extract.extract('<div class="site-header">Site, name.</div><div class="post"><p>Text, of it.</p></div><section id="comments"><p>Nice, one.</p></section>') == "Text, of it."
    deep = "<div>" * 3000 + "deep, text" + "</div>" * 10
    assert html_extract.extract(deep) == "deep, text"


def test_selected_text_outside_the_article_is_kept():
    body = "".join(f"<p>Sentence {i}, of the body, with marks, and more.</p>" for i in range(40))
    lead = "The lead, a longer one, of marks, and words, and more, and more, for a selected path."
    page = f'<div class=post><p class=lead>{lead}</p><div class=body>{body}<ul><li><a href="x">A link</a></li><li>An item of the list that is text, and longer.</li></ul></div></div>'
    out = html_extract.extract(page).split("\n")
    assert out[0] == lead and len(out) == 43 and out[-2] == "A link"


def _page(rng, names):
    """(html, article) of a made-up page; names: for the parts, so that what they are called can be nothing but noise."""
    text = lambda n: " ".join(sentence(rng, "bb", rng.randint(5, 9)).capitalize() + "." for _ in range(n))
    paragraphs = [text(rng.randint(2, 6)) for _ in range(rng.randint(3, 8))]
    items = [text(1) for _ in range(rng.randint(0, 3))]
    head = sentence(rng, "bb", 5)
    ad, comments = text(1), [text(1) for _ in range(rng.randint(1, 4))]
    inner = f"<h1>{head}</h1><p>{paragraphs[0]}</p><div class='{names[0]}'>{ad}</div>" + "".join(f"<p>{p}</p>" for p in paragraphs[1:])
    inner += ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>") * bool(items)
    inner += f"<div class='{names[1]}'>" + "".join(f"<div class='{names[2]}'><b>user</b><p>{c}</p></div>" for c in comments) + "</div>"
    menu = "".join(f"<li><a href='#'>{sentence(rng, 'aa', 1)}</a></li>" for _ in range(5))
    page = f"<html><head><title>x</title></head><body><div class='{names[3]}'><ul>{menu}</ul></div><div class='{names[4]}'>{inner}</div><div class='{names[5]}'>{text(1)}</div></body></html>"
    return page, "\n".join([head, *paragraphs, *items])


def _brute_extract(page):
    """The same paths from another parser, with all pairs of paths compared step by step."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__()
            self.at, self.text, self.found = [], "", []

        def block(self):
            if self.text.split():
                inner = [k for k, x in enumerate(self.at) if x[0] in html_extract.BLOCK][-1] + 1
                links = len(self.text) if any(x[0] == "a" for x in self.at) else 0
                self.found.append((tuple(self.at[:inner]), " ".join(self.text.split()), links, any(x[0] in html_extract.NEVER for x in self.at)))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in html_extract.BLOCK:
                self.block()
            self.at.append((tag, dict(attrs).get("class", "")))

        def handle_endtag(self, tag):
            if tag in html_extract.BLOCK or tag == "a":
                self.block()
            self.at.pop()

        def handle_data(self, data):
            self.text += data

    parser = Parser()
    parser.feed(page)
    found = [x for x in parser.found if not x[3]]
    length = lambda step: 0.25 if step[1] in ("post", "entry") else (2.0 if step[1] or step[0] in ("html", "body") else 0.75) if step[0] in ("div", "html", "body") else 0.25
    against = lambda path: any(html_extract.NAMED.search(c) for _, c in path)

    def distance(p, q):
        common = 0
        while common < min(len(p), len(q)) and p[common] == q[common]:
            common += 1
        return sum(map(length, p[common:])) + sum(map(length, q[common:]))

    paths = {p for p, *_ in found}
    own = {p: [x for x in found if x[0] == p] for p in paths}
    chars = {p: sum(len(t) for _, t, *_ in own[p]) for p in paths}
    links = {p: sum(k for _, _, k, _ in own[p]) / chars[p] for p in paths}
    marks = {p: sum(c in ".,;:!?" for _, t, *_ in own[p] for c in t) / len(own[p]) for p in paths}
    titled = [p[: max(k for k, x in enumerate(p) if x[0] in html_extract.CONTAINER) + 1] for p in paths if p[-1][0] == "h1"]
    inside = lambda p: any(p[: len(t)] == t for t in titled)
    ratio = {p: chars[p] / len(own[p]) * (1 + marks[p]) * (1 - links[p]) * (0.1 if against(p) else 1) * (10 if inside(p) else 1) for p in paths}
    mass = {p: chars[p] * (0.1 if against(p) else 1) for p in paths}
    score = {}
    for p in paths:
        share = min(1, sum(mass[q] * math.exp(-distance(p, q)) for q in paths) / sum(mass.values()))
        score[p] = max(ratio[q] * math.exp(-distance(p, q)) for q in paths) * math.sqrt(share) * (0.1 if against(p) else 1) * (1 - links[p] if links[p] > 0.5 else 1)
    limit = min(0.5 * float(np.std(list(score.values()))), max(score.values()))
    return "\n".join(t for p, t, *_ in found if score[p] >= limit)


@pytest.mark.parametrize("names", [("q1", "q2", "q3", "q4", "q5", "q6"), ("ad", "comments", "comment", "nav", "post", "footer"), ("", "q2", "q3", "", "", "")])
def test_tag_paths_match_brute_force(names):
    import random

    rng = random.Random(31)
    pages = [_page(rng, names) for _ in range(60)]
    out = [html_extract.extract(page) for page, _ in pages]
    assert out == [_brute_extract(page) for page, _ in pages]
    if names[0]:
        # Whatever the parts are called, advert, comments, menu and footer go and the article stays.
        assert sum(o == want for o, (_, want) in zip(out, pages, strict=True)) >= 57


def test_deep_pages_take_little_time():
    import time

    for tag, end in (("div", "</div>"), ("b", "</u>"), ("ul><li", "</li>")):
        began = time.process_time()
        html_extract.extract(f"<{tag}>" * 20_000 + end * 10_000 + "deep, text" + "<p>x</p>" * 1000)
        assert time.process_time() - began < 2


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, ""), (None, "v", "<p>Hi.</p>" * 3, "")], "page_id long, url string, html string, text string")
    out = rows_of(html_extract.extract_pages(pages))
    assert len(out) == 4 and [r["n_chars"] for r in out if r["page_id"] == 2] == [0]
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark)
    path = tmp_path / "sf"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(67, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, now, str(path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == before.columns and now.count() > 0
    whole = corpus_pipeline.run(spark, str(path))
    assert sorted(map(tuple, now.drop("sequence_id", "offset").collect()), key=str) == sorted(map(tuple, whole.drop("sequence_id", "offset").collect()), key=str)

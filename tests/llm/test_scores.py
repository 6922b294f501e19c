import itertools
import math
import time
import zlib

import numpy as np

from tesserae.llm import common, langid, quality, toxicity


def brute_chain(scores, trans):
    n = len(scores)
    total, good = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(s * l for s, l in zip(scores, labels)) + sum(trans[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        good += w * np.array(labels)
    return good / total


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    sizes = [3, 0, 1, 7, 5]
    starts = np.cumsum([0, *sizes])
    scores, trans = rng.normal(size=starts[-1]), rng.normal(size=(2, 2))
    marg, pairs = quality.forward_backward(scores, starts, trans)
    for k, n in enumerate(sizes):
        if n:
            assert np.allclose(marg[starts[k] : starts[k + 1]], brute_chain(scores[starts[k] : starts[k + 1]], trans))
        assert np.isclose(pairs[k].sum(), max(n - 1, 0))


def corpus():
    good = "The rane of thesha onti.\nAnd here is more text, as it was. Ends well.\nA third line of words."
    bad = "BUY!! NOW!! CHEAP!! OFFER!!\nwin | win | win | win | win\nwin | win | cash | cash"
    rows = []
    for i in range(240):
        text = (good if i % 2 else bad) + f" w{i}" + (" you vile skunkert" if i % 3 == 0 else "")
        rows.append((i, text, "en" if i % 2 else "fr", "s", i % 2, int(i % 3 == 0)))
    return rows


def frames(spark):
    rows = corpus()
    docs = [(r[0], r[1], r[2], r[3], 5) for r in rows] + [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "12 !!", "en", None, 0), (1003, "x" * 300_000, "en", "s", 1), (None, "a b", "en", "s", 1)]
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, lang string, source string, score long")
    lab = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows] + [(0, 0, 1), (None, 1, 0), (1000, None, None)], "doc_id long, quality int, toxic int")
    return d, lab


def test_quality(spark):
    d, lab = frames(spark)
    got = quality.op1_crf_quality(spark, "", d, lab).collect()
    assert len(got) == d.count()
    by = {r.doc_id: r for r in got}
    assert by[1000].score == 0.0 and by[1001].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert np.mean([by[i].predicted == i % 2 for i in range(240) if by[i].held_out]) > 0.95
    none = quality.op1_crf_quality(spark, "", d, lab.limit(0)).collect()
    assert {r.score for r in none if r.doc_id == 3} == {0.5}
    assert quality.op1_crf_quality(spark, "", d.limit(0), lab).count() == 0


def test_language(spark):
    d, _ = frames(spark)
    got = langid.op8_ecoc_language(spark, "", d).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == d.count()
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und"
    assert np.mean([by[i].lang_pred == ("en" if i % 2 else "fr") for i in range(240) if by[i].held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    unknown = langid.op8_ecoc_language(spark, "", d.withColumn("lang", d.lang.substr(9, 1)).filter("lang is null")).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    kept = langid.keep_identified(d, langid.train(d))
    assert kept.columns == d.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.op8_ecoc_language(spark, "", d.limit(0)).count() == 0


def test_codebook_keeps_codewords_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.codebook(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= 1


def test_folding():
    assert toxicity.fold("You 1d10t!") == " you idiot "
    assert toxicity.fold("scυm, ｌｏｓｅｒ m0r0n") == " scum loser moron "
    assert toxicity.fold("a 2024 b") == " a 2024 b "


def test_exceptions_cancel():
    lex = toxicity.Lexicon({"trash": 2.0}, ("trash can",))
    a = lex.automaton()
    assert lex.matches(a, toxicity.fold("the trash can is full")) == []
    assert len(lex.matches(a, toxicity.fold("you trash, can it"))) == 0
    assert len(lex.matches(a, toxicity.fold("you are trash"))) == 1


def test_toxicity(spark):
    d, lab = frames(spark)
    got = toxicity.op9_lexicon_toxicity(spark, "", d, lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == d.count()
    assert all(by[i].predicted == int(i % 3 == 0) for i in range(240))
    assert all(by[i].predicted == 0 for i in (1000, 1001, 1002, 1003))
    none = toxicity.op9_lexicon_toxicity(spark, "", d, lab.limit(0)).collect()
    assert len(none) == d.count() and all(0 <= r.score <= 1 for r in none)
    assert toxicity.op9_lexicon_toxicity(spark, "", d.limit(0), lab).count() == 0


def test_quality_against_enumeration(spark):
    """The query's scores against the sum over all label sequences of each document's lines."""
    d, lab = frames(spark)
    model = quality.train(d, lab)
    got = {r.doc_id: r.score for r in quality.op1_crf_quality(spark, "", d, lab).filter("doc_id < 40").collect()}
    texts = {r.doc_id: r.text for r in d.filter("doc_id < 40").collect()}
    for doc, text in texts.items():
        rows, sizes = quality.line_features(text)
        blank = [0.0] * len(rows[0])
        full = [[*own, *(rows[i - 1] if i else blank), *(rows[i + 1] if i + 1 < len(rows) else blank)] for i, own in enumerate(rows)]
        scores = [sum(w * (x - m) / s for w, x, m, s in zip(model.w, line, model.mean, model.spread)) for line in full]
        marg = brute_chain(scores, model.trans)
        q = sum(n * g for n, g in zip(sizes, marg)) / sum(sizes)
        z = model.slope * math.log(q / (1 - q)) + model.shift
        assert math.isclose(got[doc], 1 / (1 + math.exp(-z)), rel_tol=1e-6, abs_tol=1e-9)


def slow_language(model, text):
    """Language and score by counting n-grams one by one and trying every codeword."""
    counts = {}
    b = f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} ".encode()
    clean = []
    for c in b:
        if not (c == 32 and clean and clean[-1] == 32):
            clean.append(c)
    for n in range(1, 5):
        for i in range(len(clean) - n + 1):
            g = 0
            for c in clean[i : i + n]:
                g = g << 8 | c
            h = (g + ((n - 1) * 0x9E3779B1 & 0xFFFFFFFF)) % 2**32 * 0x85EBCA6B % 2**32
            k = (h ^ h >> 15) % langid.BUCKETS
            counts[k] = counts.get(k, 0) + 1
    norm = math.sqrt(sum(counts.values()))
    margin = [sum(math.sqrt(v) / norm * model.w[k, j] for k, v in counts.items()) + model.b[j] for j in range(len(model.b))]
    loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margin)) * 2 / len(word) for word in model.code]
    least = min(loss)
    share = [math.exp(-2 * (v - least)) for v in loss]
    return model.languages[loss.index(least)], max(share) / sum(share)


def test_language_against_slow_decoding(spark):
    d, _ = frames(spark)
    model = langid.train(d)
    for r in langid.op8_ecoc_language(spark, "", d).filter("doc_id < 30").join(d.select("doc_id", "text"), "doc_id").collect():
        lang, score = slow_language(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def slow_toxicity(lexicon, text):
    folded = toxicity.fold(text or "")
    words = folded.split()
    spared, at, total, worst, places = set(), 1, 0.0, 0.0, []
    for phrase in lexicon.exceptions:
        for i in range(len(folded)):
            if folded.startswith(f" {phrase} ", i):
                spared.update(range(i, i + len(phrase) + 1))
    for w in words:
        heavy = max((v for t, v in lexicon.terms.items() if w.startswith(t)), default=None)
        if heavy is not None and at - 1 not in spared:
            total, worst = total + heavy, max(worst, heavy)
            places.append(at - 1)
        at += len(w) + 1
    z = sum(c * f for c, f in zip(lexicon.curve, (1.0, worst, math.log1p(total), math.sqrt(total / max(folded.count(" "), 1)))))
    return 1 / (1 + math.exp(-z)), len(places)


def test_toxicity_against_slow_matching(spark):
    d, lab = frames(spark)
    extra = [(2000, "a trash can, and 1d10t pr00f idiot proof idiots", "en", "s", 1), (2001, "scum pond scum scum", "en", "s", 1)]
    d = d.unionByName(spark.createDataFrame(extra, d.schema))
    lexicon = toxicity.learn(d, lab)
    for r in toxicity.op9_lexicon_toxicity(spark, "", d, lab).filter("doc_id < 30 or doc_id >= 2000").join(d.select("doc_id", "text").distinct(), "doc_id").collect():
        score, n = slow_toxicity(lexicon, r.text)
        assert abs(r.score - score) < 1e-9 and r.n_matches == n


def test_conflicting_labels_and_null_ids_teach_nothing(spark):
    d, lab = frames(spark)
    both = lab.unionByName(lab.filter("doc_id < 100").selectExpr("doc_id", "1 - quality AS quality", "1 - toxic AS toxic"))
    apart = lab.filter("doc_id >= 100")
    one, two = quality.train(d, both), quality.train(d, apart)
    assert np.allclose(one.w, two.w) and toxicity.learn(d, both) == toxicity.learn(d, apart)
    nulls = d.unionByName(spark.createDataFrame([(None, f"zz {i}", "xx", "s", 1) for i in range(50)], d.schema))
    assert langid.train(nulls).languages == langid.train(d).languages
    copies = d.unionByName(d.filter("doc_id < 5"))
    assert np.allclose(quality.train(copies, lab).w, quality.train(d, lab).w)


def test_every_language_of_a_labelled_id_is_learned(spark):
    """One id with very many rows, and three hundred languages of one document each, beside many of another."""
    free = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"the house and the {i}th garden", "en") for i in free[:500]] + [(free[600 + n], f"{chr(0x4E00 + n)} wort {n}", f"l{n}") for n in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = spark.range(100_000).selectExpr(f"{free[550]}L AS doc_id", "concat('der die das und ', id % 7) AS text", "'de' AS lang")
    for seed in range(2):
        assert langid.train(d.unionByName(many), bound=20 + seed).languages == sorted({"en", "de"} | {f"l{n}" for n in range(300)})
    two = langid.train(d.filter("lang = 'en'").unionByName(many))
    assert two.languages == ["de", "en"] and two.decode(["der die und das", "the house and garden"])[0] == ["de", "en"]


def test_training_bytes_are_bounded(spark):
    free = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, ("A good line of text.\n" if k % 2 else "#### @@@ %%%\n") * (200_000 if k == 0 else 50), k % 2) for k, i in enumerate(free[:200])]
    d = spark.createDataFrame(rows, "doc_id long, text string, y int")
    assert sum(len(t) for _, t, _ in rows[1:]) > 160_000
    n = common.within_bytes(d, "doc_id", "text", 100_000).selectExpr("sum(octet_length(text))").first()[0]
    assert 70_000 < n < 130_000
    assert common.within_bytes(d, "doc_id", "text", 1 << 30).count() == len(rows)


def test_long_varied_texts(spark):
    """Texts of a megabyte and more, of many different words and lines, are scored whole and in time."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{chr(97 + k % 26)}{k}" for k in range(5000)])
    long = "\n".join(" ".join(line) for line in words[rng.integers(0, 5000, (20_000, 8))])
    d, lab = frames(spark)
    d = d.unionByName(spark.createDataFrame([(3000, long, "en", "s", 1), (3001, long + " trash idiot", "en", "s", 1)], d.schema))
    for query in (quality.op1_crf_quality, toxicity.op9_lexicon_toxicity):
        got = query(spark, "", d, lab).filter("doc_id >= 3000").collect()
        assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
    got = {r.doc_id: r for r in langid.op8_ecoc_language(spark, "", d).filter("doc_id >= 3000").collect()}
    model = langid.train(d)
    assert got[3000].lang_pred == slow_language(model, long)[0]


def test_long_texts_take_linear_time():
    lex = toxicity.Lexicon({"trash": 2.0}, ("trash can",))
    a, text = lex.automaton(), toxicity.fold("trash can trash " * 300_000)
    begin = time.perf_counter()
    assert len(lex.matches(a, text)) == 300_000
    assert time.perf_counter() - begin < 20

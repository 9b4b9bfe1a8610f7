"""Language, toxicity and language-model scores: held-out accuracy and plain models."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelflife.llm import backoff_lm, langid, sampling, toxicity
from shelflife.llm.queries import QUERIES
from tests.llm.docs import DOCS, lower, odd_texts, table, words

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    found = QUERIES["op6_language"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.05


def test_language_of_odd_rows(spark):
    docs = table(spark, odd_texts() + [(100 + k, t * 30) for k, t in enumerate(["the quick fox ", "der schnelle fuchs "] * 9)])
    found = langid.identify(docs, langid.train(docs)).collect()
    assert len(found) == docs.count()
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {6, 7, 8, 20, 21, None}
    assert all(r["score"] == 0 and r["rejected"] for r in found if r["lang_pred"] == "und")
    nothing = langid.identify(docs, langid.train(docs.where("lang IS NULL"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identify(spark.createDataFrame([], DOCS), None).count() == 0


@pytest.mark.parametrize("length", range(6))
def test_texts_shorter_than_an_ngram_have_their_own_grams_only(length):
    data = np.frombuffer(b"abcde"[:length], np.uint8)
    both = np.frombuffer(b"abcde"[:length] + b"longer text", np.uint8)
    for size in langid.SIZES:
        alone = langid.gram_buckets(data, np.array([0, length]), size)
        beside = langid.gram_buckets(both, np.array([0, length, len(both)]), size)
        assert (alone == beside[:length]).all()
        assert (alone < langid.BUCKETS).sum() == max(0, length - size + 1)


def test_language_of_texts_of_few_bytes(spark):
    """A language's shortest text is always learned, and a batch may end with one."""
    short = [(k, t) for k, t in enumerate(["ab", "\u00e9", "x", "No", "a", "abc", "no", "", None, ".."] * 2)]
    docs = table(spark, [*short, *[(100 + k, t * 30) for k, t in enumerate(["the quick fox ", "der schnelle fuchs "] * 9)]])
    found = langid.identify(docs, langid.train(docs)).collect()
    assert len(found) == docs.count()
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {k for k, t in short if not t or t == ".."}
    only = table(spark, [(1, "ab"), (2, "no")])
    assert {r["lang_pred"] for r in langid.identify(only, langid.train(only)).collect()} <= {"en", "de"}


def test_toxicity_finds_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op9_toxicity"](spark, SF).join(labels.select("doc_id", "quality", F.col("toxic").alias("label")), "doc_id").collect()
    clean = [r["toxic"] for r in rows if not r["label"]]
    assert np.mean(clean) < 0.02
    # Texts of low quality may have lost the words that made them toxic.
    assert np.mean([r["toxic"] for r in rows if r["label"] and r["quality"]]) > 0.8


def test_toxicity_of_odd_rows(spark):
    docs = table(spark, odd_texts() + [(100 + k, "plain words here " + ("vile " if k % 2 else "") * 3) for k in range(40)])
    labels = spark.createDataFrame(
        [(100 + k, 1, k % 2) for k in range(30)] + [(101, 1, 1), (None, 1, 1), (999, 0, 1), (1, None, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = toxicity.detect(docs, labels)
    assert found.columns == [*docs.columns, "toxicity"]
    by_id = {r["doc_id"]: r for r in found.withColumn("bad", toxicity.is_toxic()).collect()}
    assert all(by_id[100 + k]["bad"] == bool(k % 2) for k in range(40))
    assert not by_id[7]["bad"] and not by_id[6]["bad"]
    without = toxicity.detect(docs, labels.where("false")).collect()
    assert all(list(r["toxicity"]) == [0.0, 0.0] for r in without)
    assert toxicity.detect(spark.createDataFrame([], DOCS), labels).count() == 0


def test_chain_uses_the_earlier_category():
    rng = np.random.default_rng(0)
    first = rng.random(400) < 0.5
    texts = [("alpha beta " if a else "gamma delta ").encode() + b"pad" for a in first]
    labels = np.stack([first, first], axis=1).astype(int)
    chain = toxicity.fit(texts, labels, ["a", "b"])
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert chain.weights[1][-2] > 0.05


def base_scores(rows, learned):
    tokens = [[*words(lower(t)), None] for _, t in rows]
    counts = Counter(x for t, use in zip(tokens, learned) if use for x in t)
    n, v = sum(counts.values()), len(counts)
    return n, [
        (len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for t in tokens
    ]


def test_backoff_query_has_the_base_scores(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    n, expected = base_scores(rows, [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows])
    found = QUERIES["op8_backoff_lm"](spark, SF).orderBy("doc_id").collect()
    for r, (tokens, known, base) in zip(found, expected):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def gram_counts(texts):
    """Counts of words, and of what follows each word and each pair, from tokenized texts."""
    counts = {}
    for text in texts:
        for k, word in enumerate(text):
            counts[(word,)] = counts.get((word,), 0) + 1
            for m in (1, 2):
                if k >= m:
                    arcs = counts.setdefault(("after", *text[k - m : k]), {})
                    arcs[word] = arcs.get(word, 0) + 1
    v = sum(len(key) == 1 for key in counts)
    return counts, sum(c for key, c in counts.items() if len(key) == 1), v


def probability(counts, n, v, state, w):
    """The probability of a word after a state, from the counts of all n-grams."""
    if not state:
        return (counts.get((w,), 0) + 1) / (n + v + 1)
    arcs = counts.get(("after", *state))
    if not arcs:
        return probability(counts, n, v, state[1:], w)
    total = sum(arcs.values())
    if w in arcs:
        return (arcs[w] - 0.5) / total
    left = max(0.5 * len(arcs) / total, 1e-9)
    lower = sum(probability(counts, n, v, state[1:], x) for x in arcs)
    return left / max(1 - lower, 1e-9) * probability(counts, n, v, state[1:], w)


def walk(counts, n, v, text):
    """The automaton, one token after the other, with explicit states and failure arcs."""
    state, total = (), 0.0
    for w in text:
        while state and w not in counts.get(("after", *state), {}):
            arcs = counts.get(("after", *state))
            if arcs:
                left = max(0.5 * len(arcs) / sum(arcs.values()), 1e-9)
                lower = sum(probability(counts, n, v, state[1:], x) for x in arcs)
                total += math.log10(left / max(1 - lower, 1e-9))
            state = state[1:]
        total += math.log10(probability(counts, n, v, state, w))
        # The longest suffix of what was read that is a state.
        history = (*state, w)[-2:]
        while history and ("after", *history) not in counts:
            history = history[1:]
        state = history
    return total


SIZES = [{}, {"chunk_tokens": 500, "bucket_tokens": 1000}, {"chunk_tokens": 1, "bucket_tokens": 300}]


def odd_rows():
    rows = odd_texts() + [(200 + k, "the cat sat on the mat and the cat ran " * (k % 3 + 1)) for k in range(12)]
    rows += [(300, "rare words once"), (None, "rare words once more"), (None, "other rare words"), (None, "words once more")]
    return rows + [(301, "twice in one twice in one other"), (None, "twice in one twice in two"), (None, "the cat sat on a mat")]


@pytest.mark.parametrize("sizes", SIZES)
def test_no_rare_gram_is_left_out(spark, sizes):
    rows = odd_rows()
    texts = [[*words(lower(t)), None] for _, t in rows]
    counted = gram_counts([text for (i, _), text in zip(rows, texts) if i is not None])
    docs = table(spark, rows)
    scored = backoff_lm.score(docs, F.col("doc_id").isNotNull(), **sizes)
    assert scored.columns == [*(c for c in docs.columns if c != "text"), "lm"]
    got = sorted((str(r["doc_id"]), r["lm"]["n_tokens"], r["lm"]["score"]) for r in scored.collect())
    logs = lambda t: sum(math.log10(probability(*counted, tuple(t[max(0, k - 2) : k]), w)) for k, w in enumerate(t))
    expected = sorted((str(i), len(t), logs(t)) for (i, _), t in zip(rows, texts))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])


def test_traversal_equals_the_automaton(spark):
    rows = odd_rows()
    texts = [[*words(lower(t)), None] for _, t in rows]
    counted = gram_counts([text for (i, _), text in zip(rows, texts) if i is not None])
    scored = backoff_lm.score(table(spark, rows), F.col("doc_id").isNotNull(), chunk_tokens=2000)
    got = Counter((r["doc_id"], r["lm"]["n_tokens"], round(r["lm"]["score"], 6)) for r in scored.collect())
    assert got == Counter((i, len(t), round(walk(*counted, t), 6)) for (i, _), t in zip(rows, texts))


def test_states_are_normalised(spark):
    """The learned text and one text for every word that may follow a state: their probabilities sum to one."""
    vocabulary, states = ["a", "b", "c", "d"], ["a", "b", "d", "a b", "b a", "c c"]
    rows = [(k, "a b a c a b d b a") for k in range(5)] + [(9, "b a d c")]
    rows += [(None, f"{state} {w}") for state in states for w in [*vocabulary, "unseen"]] + [(None, state) for state in states]
    found = backoff_lm.score(table(spark, rows).withColumn("kept", F.col("text")), F.col("doc_id").isNotNull()).collect()
    score = {r["kept"]: r["lm"]["score"] for r in found}
    counted = gram_counts([[*words(t), None] for i, t in rows if i is not None])
    end = lambda *state: math.log10(probability(*counted, tuple(x.encode() for x in state), None))
    for state in states:
        before = score[state] - end(*state.split())
        following = sum(10 ** (score[f"{state} {w}"] - end(state.split()[-1], w) - before) for w in [*vocabulary, "unseen"])
        assert following + 10 ** end(*state.split()) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOCS)
    assert backoff_lm.score(empty, F.lit(True)).count() == 0
    found = backoff_lm.score(table(spark, odd_texts()), F.lit(None).cast("boolean")).collect()
    assert len(found) == len(odd_texts())
    assert all(r["lm"]["n_known"] == 0 and r["lm"]["score"] == 0.0 and r["lm"]["train_tokens"] == 0 for r in found)


def test_labels_with_long_texts_only_are_learned(spark):
    """Texts beyond MOST_CHARS are examples where a label has no shorter ones."""
    long = {"aa": "zwei wörter hier und dort ", "bb": "due parole qui e la "}
    rows = [(k, f"{k} " + ("two words here and there " * 20)) for k in range(400)]
    rows += [(400 + k, f"{k} " + long[("aa", "bb")[k % 2]] * 600) for k in range(400)]
    lang = lambda i: "en" if i < 400 else ("aa", "bb")[i % 2]
    docs = spark.createDataFrame([(i, t, lang(i)) for i, t in rows], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(found[i] == lang(i) for i, _ in rows)
    texts = [(k, ("plain words here " * 700) + ("vile " * 40 if k % 2 else "")) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    scored = toxicity.detect(docs, labels).withColumn("bad", toxicity.is_toxic()).collect()
    assert all(r["bad"] == bool(r["doc_id"] % 2) for r in scored)


def test_sample_is_bounded_and_holds_every_label(spark):
    rows = [("short", k, 100) for k in range(5000)] + [("long", k, 1 << (14 + k % 10)) for k in range(500)]
    rows += [("huge", 7, 1 << 30), ("huge", 8, 1 << 31), (None, 3, 5)] + [("copies", 1, 50)] * 5000
    texts = spark.createDataFrame(rows, "label string, k long, chars long").select("label", F.xxhash64("k").alias("hash"), "chars")
    drawn = sampling.sample_each(texts, 100).collect()
    n = Counter(r["label"] for r in drawn)
    assert 70 < n["short"] <= 120 and n["huge"] == n["copies"] == 1 and 0 < n["long"] <= 120 and None not in n
    assert sum(r["chars"] for r in drawn if r["label"] == "long") <= 3 * 100 * sampling.MOST_CHARS
    assert sorted(drawn) == sorted(sampling.sample_each(texts, 100).collect())

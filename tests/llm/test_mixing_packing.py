"""Packing, mixing, quality rules, Hamming search and the pipeline."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelflife.llm import hamming, mixing, packing, quality
from shelflife.llm.oracles import ORACLES
from shelflife.llm.queries import QUERIES
from tests.llm.docs import DOCS, odd_texts, table, words
from verification.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) is None


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_packed_pieces_are_the_documents(spark):
    coder = tokenizer()
    rows = odd_texts()
    found = packing.pack(table(spark, rows), packing.public_encoder).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= packing.LENGTH
    assert sum(sum(r["length"] for r in s) < packing.LENGTH for s in sequences.values()) <= 3
    got = Counter()
    for key, pieces in itertools.groupby(sorted(found, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["start"])), key=lambda r: (r["doc_id"], r["doc_tokens"])):
        pieces = list(pieces)
        got[key] += sum(r["length"] for r in pieces)
    expected = Counter()
    for i, t in rows:
        n = len(coder.encode(t or "", add_special_tokens=False).ids) + 1
        expected[i, n] += n
    assert got == expected


def test_pack_query_round_trip(spark):
    coder = tokenizer()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_doc = {}
    for r in QUERIES["op1_pack_windows"](spark, SF).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids, at = np.array([*coder.encode(texts[i], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_added_tokens_are_found_in_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a{end}b", f"x {end} y", end, f" {end}  y\n{end}", end * 3, f"{end[:-1]} {end}>", "no end", "", f"<{end} 's{end}'s"]
    texts += [t for _, t in odd_texts() if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["packing"]
    for found in (QUERIES["op1_pack_windows"](spark, str(tmp_path)), stage(spark, docs, str(tmp_path))):
        got = {}
        for r in found.collect():
            got.setdefault(r["doc_id"], []).append(r)
        for i, text in enumerate(texts):
            ids, at = np.array([*coder.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
            for r in sorted(got[i], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(ids))
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)


def test_items_go_where_the_sum_of_squares_is_least():
    rng = np.random.default_rng(5)
    levels, counts = packing.Levels(16), Counter()
    for _ in range(400):
        size = int(rng.integers(1, 16))
        before = {h: n for h, n in counts.items() if n}

        def squares(h):
            after = Counter(before)
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] += 1
            return sum(n * n for n in after.values())

        least = min(squares(h) for h in [0, *before] if h + size <= 16)
        levels.place(size, size)
        counts = Counter({h: int(n) for h, n in enumerate(levels.counts) if n})
        assert sum(n * n for n in counts.values()) == least


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), packing.public_encoder).count() == 0


def test_mix_takes_about_the_targets(spark):
    rows = QUERIES["op10_mix_sources"](spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()
    source = {r["doc_id"]: r["source"] for r in docs}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {s for s in sizes if not sizes[s]}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_targets_share_the_excess_again(spark):
    for sizes in ({"a": 10, "b": 1000, None: 5, "c": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 1}, {"b": 1, "z": 900, "é": 3, "Z": 2}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert found == pytest.approx(fill(sizes))


def test_mixing_odd_rows(spark):
    docs = table(spark, odd_texts())
    once, again = (sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str) for _ in range(2))
    assert once == again and len(once) == docs.count()
    sizes = Counter((r[0], r[2]) for r in once)
    assert sizes == Counter((i, len(words(t))) for i, t in odd_texts())
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r[5] for r in once)
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).count() == 0


def repeated(w, k=8):
    seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return len({j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})


def test_quality_of_odd_rows(spark):
    rows = odd_texts()
    docs = table(spark, rows)
    found = quality.clean_lines(docs)
    assert found.columns == [*docs.columns, "quality"]
    expected = Counter()
    for i, t in rows:
        w, text = words(t), t or ""
        lines = [x for x in text.split("\n") if x.encode().split()]
        n, r = len(w), repeated(w)
        expected[i, n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n] += 1
    got = Counter(tuple(r) for r in found.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed").collect())
    assert got == expected
    assert quality.clean_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_are_judged_one_by_one(spark):
    good = "A sentence of some length ends here. And then another one."
    lines = [good, "Home | News | Sport | About us.", "no end of a sentence", "All rights reserved.", "!!! *** ??? ... !!!", "", good]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["quality"] for r in quality.clean_lines(df).collect()}
    assert found[1]["clean_text"] == f"{good}\n{good}"
    assert found[1]["n_dup_lines"] == 1
    assert (found[2]["n_words"], found[2]["clean_text"], found[2]["kept"]) == (0, "", False)


def nearest(ids, codes, q, k):
    far = sorted((bin(codes[j] ^ codes[q]).count("1"), ids[j]) for j in range(len(ids)) if ids[j] != ids[q])
    return far[:k]


@pytest.mark.parametrize("blocks", [(1 << 17, 1 << 12), (40, 3)])
def test_hamming_search_is_exact(spark, blocks):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 64))
    x[100:150] = x[7]  # one very common vector
    x[150:] = x[rng.integers(0, 60, 50)] + rng.normal(size=(50, 64)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = hamming.nearest_codes(hamming.sign_codes(df, "embedding"), "vec_id", F.col("vec_id") % 25 == 0, 10, *blocks)
    codes = [int("".join("1" if y > 0 else "0" for y in v), 2) for v in x]
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["neighbor_id"]))
    assert got == {q: nearest(list(range(200)), codes, q, 10) for q in range(0, 200, 25)}


def test_hamming_search_of_odd_rows(spark):
    rows = [(0, [1.0, -1.0]), (0, [1.0, -1.0]), (1, None), (2, []), (3, [1.0, None]), (50, [1.0, -1.0, 2.0]), (None, [1.0]), (51, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = hamming.nearest_codes(hamming.sign_codes(df, "embedding"), "vec_id", F.col("vec_id") % 50 == 0)
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(0, 1, 50, 1), (0, 2, 51, 1), (50, 1, 0, 1), (50, 2, 51, 2)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert hamming.nearest_codes(hamming.sign_codes(empty, "embedding"), "vec_id", F.lit(True)).count() == 0


def test_near_duplicates_under_equal_and_null_ids(spark):
    """Of each group of rows with similar texts one row stays, whatever the ids."""
    long = " ".join(f"w{k}" for k in range(200))
    near = long.replace("w77 ", "other ")
    rows = [(None, long), (5, near), (5, long), (5, "short text"), (None, "short text"), (None, None), (7, None), (7, ""), (3, "something else")]
    found = dict(corpus_pipeline.STAGES)["minhash near-dedup"](spark, table(spark, rows), SF)
    assert found.columns == DOCS.names
    got = [(r["doc_id"], r["text"]) for r in found.collect()]
    assert len(got) == 6 and Counter(i for i, _ in got) == Counter([5, 5, None, 7, 7, 3])
    assert [t for i, t in got if i == 5 and t != "short text"][0] in (long, near)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).join(docs.groupBy("doc_id").count(), "doc_id")
    assert tokens.count() == docs.select("doc_id").distinct().count()


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (table(spark, odd_texts()), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, str(tmp_path))
            found.collect()
            if name != "packing":
                assert found.schema.names == docs.schema.names

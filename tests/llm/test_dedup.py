"""Substring, byte and near-duplicate removal against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from shelflife.llm import bucket_refine, components as contraction, seed_extend, superminhash, windows
from shelflife.llm.components import components, merged_components
from shelflife.llm.scratch import written
from shelflife.llm.queries import QUERIES
from tests.llm.docs import DOCS, odd_texts, shingles, table, words

SF = "/root/testdata/sf0.001"


def rows_of(spark, sf_dir=SF):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def cut_words(rows, window=50):
    """(doc_id, words, removed) of each row, by comparing all windows."""
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = True
        kept = hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()
        out.append((i, len(w), int(gone.sum()), kept))
    return Counter(out)


def test_seed_extend_query_equals_brute_force(spark):
    found = Counter(tuple(r) for r in QUERIES["op4_seed_extend"](spark, SF).collect())
    assert found == cut_words(rows_of(spark))


@pytest.mark.parametrize("window, seed", [(50, 16), (12, 5)])
def test_seed_extend_on_odd_rows(spark, window, seed):
    rows = odd_texts()
    docs = table(spark, rows)
    found = seed_extend.remove_repeats(docs, window, seed)
    assert found.columns == [*docs.columns, "repeats"]
    got = Counter(
        (r["doc_id"], r["repeats"]["n_words"], r["repeats"]["n_removed"], hashlib.sha256(b" ".join(words(r["text"]))).hexdigest())
        for r in found.collect()
    )
    assert got == cut_words(rows, window)


def test_removed_spans_and_text_agree(spark):
    rows = odd_texts()
    docs = table(spark, rows).where("doc_id IS NOT NULL")
    by_text = {}
    for i, t in rows:
        by_text.setdefault(i, []).append(words(t))
    for r in seed_extend.remove_repeats(docs).collect():
        spans = r["repeats"]["removed"]
        assert sum(s["end"] - s["start"] for s in spans) == r["repeats"]["n_removed"]
        gone = {k for s in spans for k in range(s["start"], s["end"])}
        assert words(r["text"]) in [[x for k, x in enumerate(w) if k not in gone] for w in by_text[r["doc_id"]]]
        assert (r["text"] is None) == (r["doc_id"] == 6)


def cut_bytes(rows, window=400):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, kept))
    return Counter(out)


def test_bucket_refine_query_equals_brute_force(spark):
    found = Counter(tuple(r) for r in QUERIES["op5_bucket_refine"](spark, SF).collect())
    expected = Counter((*k[:4], hashlib.sha256(k[4]).hexdigest()) for k in cut_bytes(rows_of(spark)).elements())
    assert found == expected


@pytest.mark.parametrize("window, gram", [(400, 40), (60, 8)])
def test_bucket_refine_on_odd_rows(spark, window, gram):
    rows = odd_texts()
    found = bucket_refine.remove_repeated_bytes(table(spark, rows), window, gram).collect()
    assert Counter((*r[:4], bytes(r[4])) for r in found) == cut_bytes(rows, window)


def test_spans_of_many_equal_rows_are_listed_once(spark):
    """Equal rows have one list of spans, so k of them don't make k lists of k times the spans."""
    rows = odd_texts() + [(None, odd_texts()[0][1])] * 300 + [(50, odd_texts()[0][1])] * 300
    got = Counter(tuple(r) for r in bucket_refine.remove_repeated_bytes(table(spark, rows), 400, 40).select(
        "doc_id", "n_bytes", "n_removed").collect())
    n = len(odd_texts()[0][1].encode())
    assert got[None, n, n] == 301 and got[50, n, n] == 300
    spans = spark.createDataFrame([(1, 5, 0, 9)] * 500 + [(1, 5, 3, 20)] * 500, "doc_id long, _h long, start long, end long")
    docs = spark.createDataFrame([(1, 5, "x" * 30, 0)], "doc_id long, _h long, text string, _slot long")
    docs = docs.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(windows.FILTER_BITS)))

    def cut(batch, covered):
        sizes = pa.array([len(start) for start, _ in covered], pa.int64())
        return pa.RecordBatch.from_arrays([sizes], ["n"])

    listed = windows.cut_spans(docs, spans, cut, StructType().add("n", LongType())).collect()
    assert sorted(r["n"] for r in listed) == [2]


def grouped(rows):
    """(doc_id, set size, smallest linked id) of each row, by comparing all sets."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(top(x), top(y))] = min(top(x), top(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return Counter((i, len(s), i if i is None else least[top(x)]) for x, (i, s) in enumerate(sets))


def test_near_duplicates_on_odd_rows(spark):
    rows = odd_texts()
    found = superminhash.near_duplicates(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == grouped(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in found)


def test_near_duplicates_query_equals_brute_force(spark):
    found = QUERIES["op7_superminhash"](spark, SF).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == grouped(rows_of(spark))


def test_large_buckets_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "CHUNK", 4)
    base = " ".join(f"w{k}" for k in range(200)).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 30):
        rows.append((k, " ".join(w if j not in (5 * k, 5 * k + 1) else f"x{k}" for j, w in enumerate(base))))
    # A chain whose ends aren't linked.
    for k in range(1, 8):
        rows.append((100 + k, " ".join(f"c{j}" for j in range(k * 10, k * 10 + 120))))
    found = superminhash.near_duplicates(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == grouped(rows)


def superminhash_model(elements, size):
    """One element after the other, one rank after the other."""
    from shelflife.llm.text import U64, mix

    out = [2**64 - 1] * size
    for e in elements:
        order = list(range(size))
        for rank in range(size):
            drawn = int(mix(np.array([e], U64) + U64((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))[0])
            pick = rank + ((drawn & 0xFFFF) * (size - rank) >> 16)
            order[rank], order[pick] = order[pick], order[rank]
            out[order[rank]] = min(out[order[rank]], rank << 57 | drawn >> 7)
    return out


@pytest.mark.parametrize("others", [1, 7, 30])
def test_pairs_of_components_meet_and_the_largest_is_not_copied(spark, others):
    roots = [0] * 40 + [1 + k % 9 for k in range(others)]
    members = spark.createDataFrame([(5, k, 3, root) for k, root in enumerate(roots)], "key long, node long, n long, root long")
    tally = superminhash._tally(members)
    counts = tally.first()
    assert (counts.total, counts.outside, counts.largest) == (len(roots), others, 0)
    assert (counts.items_total, counts.items_outside) == (3 * len(roots), 3 * others)
    chunks, chunks_outside = (F.ceil(F.col(c) / 4) for c in ("total", "outside"))
    dealt = superminhash._met(members.join(tally, "key"), chunks, chunks_outside).select("node", "part").collect()
    assert len(dealt) == len(set(dealt))
    parts = {}
    for row in dealt:
        parts.setdefault(row.node, set()).add(row.part)
    for a, root_a in enumerate(roots):
        for b, root_b in enumerate(roots[:a]):
            assert root_a == root_b or parts[a] & parts[b]
    assert all(len(parts[k]) == -(-others // 4) for k in range(40))


def test_signatures_stop_early_without_a_change():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300, 900)]
    found = superminhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 32)
    assert [list(map(int, row)) for row in found] == [superminhash_model(s, 32) for s in sets]


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[250:1250]
    x, y = superminhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 2048)
    assert abs((x == y).mean() - 0.6) < 0.03


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 3), (10, 11), (11, 12), (20, 20), (30, 31), (5, 30), (5, 6), (4, 6)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert dict(found) == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10, 12: 10, 30: 4, 31: 4, 5: 4, 6: 4, 4: 4}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert seed_extend.remove_repeats(empty).count() == 0
    assert bucket_refine.remove_repeated_bytes(empty).count() == 0
    assert superminhash.near_duplicates(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert superminhash.near_duplicates(nothing).where(F.col("kept")).count() == 2


def test_stars_are_told_without_another_round(spark, monkeypatch):
    """A round that only confirms stars costs four stored tables."""
    stored = []
    monkeypatch.setattr(contraction, "written", lambda df, name: (stored.append(name), written(df, name))[1])
    stars = [(1, 5), (5, 1), (6, 1), (2, 9), (3, 3)]
    found = components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in found) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]
    assert stored == ["edges", "least"]


@pytest.mark.parametrize("more", [[], [(5, 20)], [(8, 9), (9, 2), (30, 31)], [(3, 20), (40, 3), (41, 40), (11, 7)]])
def test_links_merge_components_by_their_roots(spark, more):
    edges = [(1, 3), (3, 5), (2, 8), (7, 20), (20, 21)]
    roots = written(components(spark.createDataFrame(edges, "a long, b long")), "roots")
    links = written(spark.createDataFrame(more, "a long, b long"), "links")
    whole = components(spark.createDataFrame(edges + more, "a long, b long"))
    found = [(r["node"], r["root"]) for r in merged_components(roots, links).collect()]
    assert sorted(found) == sorted((r["node"], r["root"]) for r in whole.collect())
    assert len(found) == len(set(found))

"""Alignment of two tokenizers against a plain reading of the contract with the unaltered vocabulary files."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelflife.llm import token_alignment
from shelflife.llm.queries import QUERIES
from shelflife.llm.token_pairs import words_of
from tests.llm.docs import odd_texts, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    letters |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), (lambda t: b.encode(t)), bytes_a, bytes_b


def ends(ids, spell):
    at, out = 0, []
    for i in ids:
        at += len(spell(i))
        out.append(at)
    return out


def plain(vocabularies, texts):
    code_a, code_b, bytes_a, bytes_b = vocabularies
    docs, counts = [], Counter()
    for text in texts:
        a, b = (code_a(text), code_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            a, b = [], []
        ea, eb = ends(a, bytes_a), ends(b, bytes_b)
        where_b = dict(zip(eb, b))
        links = [(x, where_b[e]) for x, e in zip(a, ea) if e in where_b]
        cuts = [e for e in ea if e in where_b]
        inside = defaultdict(lambda: ([], []))
        for side, (ids, es) in enumerate(((a, ea), (b, eb))):
            for i, e in zip(ids, es):
                inside[bisect_left(cuts, e)][side].append(str(i))
        groups = ["|".join(map(",".join, inside[k])) for k in range(len(cuts))]
        spans_a, spans_b = list(zip([0, *ea], ea)), list(zip([0, *eb], eb))
        overlaps = k = 0
        for s, e in spans_a:
            while k and spans_b[k - 1][1] > s:
                k -= 1
            while k < len(spans_b) and spans_b[k][0] < e:
                overlaps += spans_b[k][1] > s
                k += 1
        docs.append((len(a), len(b), len(cuts), links, overlaps, ";".join(groups)))
        counts.update(links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "", overlaps)
        for n_a, n_b, n_groups, links, overlaps, groups in docs
    ]


def test_query_equals_brute_force(spark, vocabularies):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter((i, *r) for (i, _), r in zip(rows, plain(vocabularies, [t for _, t in rows])))
    assert Counter(tuple(r) for r in QUERIES["op13_token_alignment"](spark, SF).collect()) == want


ODD = [
    (30, "  two  spaces and\ttabs \n\n lines  "), (31, "literal ▁ mark"), (32, "<s> </s> <unk> <0x0A> <|endoftext|>"), (33, "\x00 \x1c   　x"),
    (34, "漢字 \U0001f600\U0001f600 é ﬁ ½"), (35, "don't  we'll\r\n I'm"), (36, "x" * 5000 + " y"),
]


@pytest.mark.parametrize("hot", [1 << 20, 3, 0])
def test_odd_rows(spark, vocabularies, hot):
    """Also with few or no pairs broadcast."""
    rows = odd_texts() + ODD
    docs = table(spark, rows)
    found = token_alignment.align(docs, hot_pairs=hot)
    assert found.columns == [c for c in docs.columns if c != "text"] + ["alignment"]
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    got = Counter((r["doc_id"], *[r["alignment"][c] for c in names]) for r in found.collect())
    assert got == Counter((i, *r) for (i, _), r in zip(rows, plain(vocabularies, [t for _, t in rows])))
    assert token_alignment.align(docs.limit(0)).count() == 0


def test_groups_themselves(spark, vocabularies):
    rows = odd_texts() + ODD
    docs = table(spark, rows)
    found = token_alignment.token_groups(docs)
    assert found.columns == [*docs.columns, "groups"]
    for row in found.collect():
        whole, start = (" " + (row["text"] or "")).encode(), 0
        for g in row["groups"]:
            assert b"".join(map(vocabularies[2], g["a"])) == whole[start : g["end"]] == b"".join(map(vocabularies[3], g["b"]))
            start = g["end"]
        assert start in (0, len(whole))


def test_words_join_to_the_text():
    for _, text in odd_texts() + ODD:
        if text:
            assert " ".join(words_of(text)) == text


def test_least_hot_is_bounded(spark):
    counts = spark.range(1, 2001).select(F.col("id").alias("pair"), F.expr("id div 2").alias("n")).where("n > 0")
    for most in (0, 1, 10, 700, 5000):
        least = token_alignment.least_hot(counts, most)
        assert counts.where(F.col("n") >= least).count() <= most
    assert token_alignment.least_hot(counts, 5000) == 1

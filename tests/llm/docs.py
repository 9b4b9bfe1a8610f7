"""Small tables with every odd case, and plain models of the operators' contracts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [StructField("doc_id", LongType())]
    + [StructField(c, StringType()) for c in ("text", "lang", "source")]
    + [StructField("n_chars", LongType())]
    # Names that operators use themselves.
    + [StructField(c, LongType()) for c in ("_h", "run", "node", "size", "target", "copies", "_doc", "toxicity_", "row.s")]
)


def sentence(rng: random.Random, n: int, names: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = sentence(rng, 400)
    passage = sentence(rng, 70, "klmnop")
    words = base.split()
    near = " ".join(w if i % 90 else "changed" for i, w in enumerate(words))
    out: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (9, near), (3, sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 30)),
        (4, passage + " " + sentence(rng, 9)), (5, sentence(rng, 5) + "\t" + passage), (6, None), (7, ""), (8, " \n\t "),
        (10, "one two three"), (11, "One TWO three"), (12, "żółć naïve ßtraße ünïcödé " * 40), (13, "so so " * 300),
        (14, sentence(rng, 6000)), (15, "a" * 3000), (16, base.upper()), (None, base), (None, None), (1, base), (2, "other text"),
        (17, passage.upper() + ".\nHome | News | About | Contact\nAll rights reserved."), (-5, passage + " " + passage),
        (18, "<|endoftext|> is text   and  two spaces \x1f here "), (19, "x"), (20, " "), (21, "..."),
    ]
    return out


def table(spark: SparkSession, texts: list[tuple[int | None, str | None]]) -> DataFrame:
    langs, sources = ("en", "de", None), ("s1", "s0", None)
    rows = [
        (i, t, langs[k % 3], sources[k % 3], None if t is None else len(t), *range(9)) for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None) -> set[bytes]:
    w = words(lower(text))
    if len(w) < 5:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

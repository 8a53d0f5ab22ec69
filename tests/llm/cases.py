"""Small inputs with every awkward case: nulls, empty and long texts, ties, repeats, extra columns of clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, target double, hash long, score double"
WORDS = "amber basalt cedar delta ember fjord grove heron islet jetty knoll larch moor nectar oasis prairie quartz ridge sierra tundra".split()


def prose(rnd: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        k = rnd.randint(4, 12)
        s = [rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "ed", "ly"]) + rnd.choice("abcdefgh") * rnd.randint(0, 1) for _ in range(k)]
        out += s
        out[-1] += rnd.choice([".", "!", "?", ".\n"])
    return " ".join(out[:n]).replace("\n ", "\n")


def texts() -> dict[int | None, str | None]:
    rnd = random.Random(7)
    base = prose(rnd, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(rnd, 60)
    return {
        1: base, 2: base, 3: near, 4: prose(rnd, 80) + "\n" + passage + "\n" + prose(rnd, 40), 5: prose(rnd, 70) + "\n" + passage + "\n" + prose(rnd, 50),
        6: "", 7: None, 8: "one two", 9: "one two", 10: " \t\n ", 11: "!!! ??? 123", 12: prose(rnd, 30_000), 13: "Ünïcödé — 日本語のテキスト 🙂🙂 naïve café", 14: "x" * 50_000,
        15: "<|endoftext|> said <|startoftext|>", 16: "line one has ten words or more in it for sure yes\n" * 5, 17: "a\n\n\nb\r\nc",
    }


def docs(spark: SparkSession, extra: bool = True) -> DataFrame:
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, ""][i % 4], 0, "x", 1, 1.0, 2, 3.0) for i, t in texts().items()]
    rows += [(None, "a text without an id, five words", None, None, 0, "x", 1, 1.0, 2, 3.0), rows[0], (6, None, None, None, 0, "x", 1, 1.0, 2, 3.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)

"""Lines near a doubling of sizes: guests of the next cell send only the words that can match there, and no match is lost."""

import random

from pyspark.sql import functions as F

from cindergrid.llm import linededup
from cindergrid.llm.textkit import marked


def test_guests_send_only_early_words(spark):
    rows = spark.createDataFrame([(53, list(range(11))), (63, list(range(13))), (40, list(range(9)))], "n int, prefix array<int>")
    got = {r.n: r.k for r in linededup.spread(rows, "prefix", F.col("n").alias("size")).groupBy("size").agg(F.count("*").alias("k")).toDF("n", "k").collect()}
    assert got == {53: 11 + 2, 63: 13 + 7, 40: 9}


def test_matches_across_cells_stay(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(150):
        own = base[:rng.randint(48, 80)]
        for k in rng.sample(range(len(own)), rng.randint(0, 4)):
            own[k] = f"x{rng.randint(0, 60)}"
        texts.append(" ".join(own))
    seen, want = [], {}
    for i, t in enumerate(texts):
        own = set(t.split())
        want[i] = "" if any(10 * len(own & s) >= 8 * len(own | s) for s in seen) else t
        seen.append(own)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_few_lines_that_are_not_asked_for_pass_the_bit_table(spark):
    rows = spark.range(40_000).selectExpr("id doc", "id * 7 h", "int(id % 11) no")
    asked = rows.filter("doc % 4 = 0")
    passed = rows.filter(marked(asked, "doc", "h", "no", size=1 << 16, probes=3))
    assert passed.join(asked, ["doc", "h", "no"]).count() == 10_000
    assert passed.count() < 10_000 + 2_500


def test_words_between_any_white_space(spark):
    rows = spark.createDataFrame([(" a  b\ta \rb\x0bc\x0c ",), ("c b a",), ("a",)], "line string")
    keys = [r.k for r in rows.select(linededup.word_keys(F.col("line"), linededup.ranks(rows.toDF("text"))).alias("k")).collect()]
    assert keys[0] == keys[1] and len(keys[0]) == 3 and len(keys[2]) == 1

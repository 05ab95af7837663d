"""K-d tree shards and collocations: brute force, balance, skew and edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigrade.llm import collocations, common, kd_shards

DOCS = "doc_id long, text string, lang string, source string, size string, shard int, `at` string"
EDGE = [
    (1, None, "en", "a", "x", 1, "y"), (2, "", None, None, "x", 1, "y"), (3, "  \t.,;\n", "de", "b", "x", 1, "y"), (4, "é漢😀 word", "en", "b", "x", 1, "y"),
    (5, "same text here", "en", "b", "x", 1, "y"), (5, "same text here", "en", "b", "x", 1, "y"), (None, "no id at all", None, None, None, None, None), (7, "Long word " * 30_000, "en", "c", "x", 1, "y"),
]


# ---------------------------------------------------------------- 12


def put(spark, rows, shards, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return [r.asDict() for r in kd_shards.sharded(docs, shards, **more).collect()]


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(1, 900))), rng.choice(["en", "de", None]), rng.choice("stuv")) for i in range(3000)]
    rows += [(10_000 + i, "copy " + rows[i // 4][1], "en", "s") for i in range(800)]
    out = put(spark, rows, 7)
    text = {r[0]: r[1] for r in rows}
    sizes, shards = Counter(), defaultdict(set)
    for r in out:
        assert r["size"] == len(text[r["id"]].encode()) + 16 and r["crc"] == zlib.crc32(text[r["id"]].encode())
        sizes[r["shard"]] += r["size"]
        shards[text[r["id"]]].add(r["shard"])
    assert len(out) == len(rows) and gapless(out) and set(sizes) == set(range(7))
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 7
    assert all(len(s) == 1 for s in shards.values())
    assert sorted(map(str, put(spark, rows[::-1], 7))) == sorted(map(str, out))


def test_cuts_are_weighted_medians(spark):
    """Two shards, one dimension: the cut is where a sort by it reaches half of the bytes."""
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 300) + str(i), None, None) for i in rng.sample(range(10**9), 700)]
    out = put(spark, rows, 2, dims={"order": F.col("id").cast("double")})
    left = sorted(r["id"] for r in out if r["shard"] == 0)
    order = sorted(out, key=lambda r: r["id"])
    assert left == [r["id"] for r in order[: len(left)]]
    half, done = sum(r["size"] for r in out) / 2, sum(r["size"] for r in order[: len(left)])
    assert abs(done - half) <= max(r["size"] for r in out)


def test_one_group_holds_a_third(spark):
    rows = [(i, "the same passage", "en", "hot") for i in range(2000)] + [(5, "one id", "en", "hot")] * 1000 + [(10_000 + i, f"text {i} " + "w" * (i % 9), "en", "s") for i in range(3000)]
    out = put(spark, rows, 10)
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert len(out) == 6000 and gapless(out) and max(sizes.values()) < 1.1 * min(sizes.values())


def test_shards_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    rows = kd_shards.sharded(docs, 3).collect()
    assert len(rows) == len(EDGE) and {r.shard for r in rows} <= {0, 1, 2} and gapless([r.asDict() for r in rows])
    assert sorted(r["size"] for r in rows if r["id"] in (1, 2)) == [16, 16]
    assert kd_shards.sharded(docs.where("false"), 3).count() == 0
    assert {r.shard for r in kd_shards.sharded(docs, 1).collect()} == {0}
    few = kd_shards.sharded(docs.where("doc_id < 4"), 40).collect()
    assert len(few) == 3 and gapless([r.asDict() for r in few])
    assert {r.shard for r in kd_shards.sharded(docs.where("doc_id < 4"), target_bytes=1 << 20).collect()} == {0}
    with pytest.raises(ValueError):
        kd_shards.sharded(docs)


def test_shards_run_without_python(spark):
    plan = kd_shards.sharded(spark.createDataFrame(EDGE, DOCS), 3)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- 11


def by_hand(rows, most_words, least=10, cover=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        held = [p for p, a in f.items() if len(p) > 1 and a >= least]
        rows = []
        for p in held:
            a = f[p]
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [q for q in held if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * f[q] >= cover * a for q in longer):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(n=260):
    rng = random.Random(2)
    words = ["The", "cat", "é", "漢字", "a", "b", "New", "York", "\x00", "x" * 40]
    made = []
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for _ in range(rng.randint(0, 40))]
        made.append(("".join(parts) + rng.choice(["", "a a a a", "new york city"]), rng.choice(["en", "de", None])))
    return made + [(None, "en"), ("", None), (" .,", "xx"), ("only here", "yy")]


@pytest.mark.parametrize("most_words, block_words", [(3, 1 << 18), (3, 7), (4, 5), (2, 1)])
def test_collocations_by_hand(spark, most_words, block_words):
    """Blocks of few words put phrases across their edges."""
    docs = spark.createDataFrame(texts(), "text string, lang string").repartition(3)
    got = collocations.collocations(docs, most_words=most_words, block_words=block_words)
    assert sorted(map(tuple, got.collect())) == by_hand(texts(), most_words)


def test_collocation_options(spark):
    docs = spark.createDataFrame(texts(), "text string, lang string")
    for options in ({"least": 3, "cover": 90, "top": 5}, {"least": 25, "cover": 1}):
        assert sorted(map(tuple, collocations.collocations(docs, **options).collect())) == by_hand(texts(), 3, **options)


def test_collocation_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == by_hand([(r[1], r[2]) for r in EDGE], 3)
    assert collocations.collocations(docs.where("false")).collect() == []


def test_scores_are_exact(spark):
    big = 3_037_000_507  # its square is beyond 63 bits
    rows = [("en", 2, 1, ["a", "b"], big, 1, 2, [big + 1], [big + 2]), ("en", 3, 1, ["a", "b", "c"], 10**12, 1, 2, [10**12, 10**12], [10**12 + 1, 10**12 + 1])]
    known = spark.createDataFrame(rows, "lang string, len int, id long, words array<string>, a long, first long, last long, heads array<long>, tails array<long>")
    got = {r.len: (r.l, r.r, r.score) for r in collocations.scored(known).collect()}
    assert got[2] == (big + 1, big + 2, 1_000_000 * big * big // ((big + 1) * (big + 2)))
    assert got[3] == (10**12, 10**12 + 1, 1_000_000 * 10**24 // (10**12 * (10**12 + 1)))


def test_a_task_holds_one_block(spark, tmp_path, monkeypatch):
    """Lists of up to 128 blocks' ids were held in a task at once, and tables of blocks were written and read 100 blocks at a time."""
    rows = spark.createDataFrame([(i, 2, collocations.packed(np.array([0, 1])), 2) for i in range(3)], "block long, own int, seq binary, size int")
    items = spark.createDataFrame([(0, 0, 7), (0, 1, 8), (1, 1, 8)], "block long, no int, id long")
    for last in (False, True):
        found = collocations.paired(rows, items, last)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroups" in plan and "Aggregate" not in plan
        flat = found if last else found.where("size(a) > 0").select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b"), F.col("counts")[0].alias("counts"))
        assert [tuple(r) for r in flat.collect()] == [(7, 8, 1)]
    shelf = common.Shelf(spark, "rows")
    monkeypatch.setattr(shelf, "root", str(tmp_path))
    shelf.put(spark.range(20).selectExpr("id", "transform(sequence(1, IF(id = 0, 1, 200000)), x -> xxhash64(id, x)) AS xs").coalesce(1), "big", long_rows=True)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in tmp_path.glob("*/*.parquet")]
    assert sum(groups) >= 6  # also after a row from which the next one's size can't be told

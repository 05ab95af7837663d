"""Collocations by hierarchical pair naming.

A phrase of k words is a pair of phrases of k - 1 words that overlap in all but
its first and its last word. So phrases are named level by level:

1. Texts become blocks: the words of a language's pieces as numbers into the
   block's own list of distinct words. A block holds so many words at most, and
   where a text goes on in the next one, the words that its last phrases need.
2. Words are counted, from the blocks' lists. Frequent ones get an id; the ids are
   joined to the lists, not to every occurrence, and a block's list of ids comes
   back to it. Its numbers are then ids of frequent words, or none.
3. Adjacent ids of a block are pairs; their counts are summed over all blocks, and
   frequent pairs get ids, which replace them as words were replaced. This repeats
   for the next length. A phrase's pair of ids points to its first and its last
   k - 1 words, so counts of the parts of every cut come along those pointers, and
   a phrase is within a longer one exactly if a frequent pair points to it.

All counts are exact: a phrase is as frequent as each of its parts at least, so
nothing that is dropped on the way could have been a candidate, and words are told
apart by their text. Scores are exact decimals.

What is joined on a word is a row per block and word, whatever the word's
frequency, so common words do not weigh more than others.

Defined cases: a null text has no words; a null language is ``und``; a language
without candidates gives no rows; a word or a piece of any length is taken whole;
repeated rows count each; an empty table gives no rows; other columns play no
part, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, flat, lower_table, ragged, small_batches, spans, table

LEAST, MOST_WORDS, COVER, SCALE = 10, 3, 50, 1_000_000
#: Words of a block.
BLOCK_WORDS = 1 << 18
#: What ends a piece, and what else ends a word.
PIECE_ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"


# ---------------------------------------------------------------- blocks


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, and for each whether a piece ends before it."""
    gap = np.zeros(256, bool)
    gap[list(PIECE_ENDS)] = True
    inside = ~gap
    inside[list(GAPS)] = False
    starts, ends, first = spans(data, offsets, inside)
    stops = np.searchsorted(np.flatnonzero(gap[data]), starts)
    breaks = np.diff(stops, prepend=-1) > 0
    breaks[first[:-1][first[:-1] < len(starts)]] = True
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data[inside[data]])), breaks


def cut_blocks(words: pa.Array, breaks: np.ndarray, more: int, block_words: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, int]]:
    """Blocks of words: distinct words, their counts among those that begin in the block, the words by number, and how many numbers are the block's own."""
    named = words.dictionary_encode()
    codes = named.indices.to_numpy()
    for at in range(0, len(codes), block_words):
        to = min(len(codes), at + block_words)
        own, numbers = np.unique(codes[at : to + more], return_inverse=True)
        counts = np.bincount(numbers[: to - at], minlength=len(own))
        cuts = np.flatnonzero(breaks[at : to + more])
        cuts = cuts[cuts > 0]
        yield named.dictionary.take(pa.array(own)).to_pylist(), counts, np.insert(numbers, cuts, -1), to - at + int((cuts <= to - at).sum())


def blocks(docs: DataFrame, text_col: str, lang_col: str, most_words: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, words, counts, seq, own): a block's distinct words, how often each occurs, and its words by number, -1 where a piece ends.

    Beyond its own numbers a block has the next one's first words, which are not counted.
    """
    lower = lower_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            codes = langs.indices.to_numpy()
            for n, lang in enumerate(langs.dictionary.to_pylist()):
                data, offsets = flat(batch.column(0).take(pa.array(np.flatnonzero(codes == n))))
                for words, counts, seq, own in cut_blocks(*words_of(lower[data], offsets), most_words - 1, block_words):
                    block += 1
                    cols = [pa.array([block]), pa.array([lang]), pa.array([words], pa.list_(pa.string())), listed(counts, pa.int64()), pa.array([packed(seq)], pa.binary()), pa.array([own], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, ["block", "lang", "words", "counts", "seq", "own"])

    small_batches(docs)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, seq binary, own int")


def packed(seq: np.ndarray) -> bytes:
    """Numbers of a block in few bytes: it is what is shuffled most. Bytes of equal weight lie together, so the high ones take no room."""
    return zstandard.ZstdCompressor(level=1).compress(seq.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds an array."""
    return ragged(values, np.array([0, len(values)]), kind)


# ---------------------------------------------------------------- naming


def pairs_of(seq: np.ndarray, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct adjacent pairs of ids in seq, their counts, and seq by the pairs' numbers; numbers without an id (-1) have no pairs.

    Only pairs that begin among the first ``own`` numbers count.
    """
    if len(seq) < 2 or not len(ids):
        none = np.zeros(0, np.int64)
        return none, none, none, np.full(max(0, len(seq) - 1), -1, np.int64)
    got = np.where(seq >= 0, ids[seq], -1)
    at = np.flatnonzero((got[:-1] >= 0) & (got[1:] >= 0))
    wide = np.int64(len(ids))
    keys, numbers = np.unique(seq[at].astype(np.int64) * wide + seq[at + 1], return_inverse=True)
    out = np.full(len(seq) - 1, -1, np.int64)
    out[at] = numbers
    return ids[keys // wide], ids[keys % wide], np.bincount(numbers[at < own], minlength=len(keys)), out


def paired(rows: DataFrame, items: DataFrame, last: bool = False) -> DataFrame:
    """(block, own, a, b, counts, seq) of blocks (block, own, seq, size); items (block, no, id) are those of a block's ``size`` numbers that are frequent.

    A block and its items meet as a group of its own after a sort by block, so a
    task holds one block at a time, however many it gets. Of the last level only
    the pairs are wanted: (a, b, counts), a row each.
    """

    def run(row: pa.Table, named: pa.Table) -> pa.Table:
        if not row.num_rows or not named.num_rows:  # a block without frequent numbers has no phrases either
            return kind.empty_table()
        block, own, seq, size = (row.column(c)[0].as_py() for c in ("block", "own", "seq", "size"))
        ids = np.full(size, -1, np.int64)
        ids[named.column("no").to_numpy()] = named.column("id").to_numpy()
        a, b, counts, out = pairs_of(unpacked(seq), ids, own)
        if last:
            return pa.table([pa.array(x) for x in (a, b, counts)], schema=kind)
        return pa.table([pa.array([block]), pa.array([own], pa.int32()), *(listed(x, pa.int64()) for x in (a, b, counts)), pa.array([packed(out)], pa.binary())], schema=kind)

    schema = "a long, b long, counts long" if last else "block long, own int, a array<long>, b array<long>, counts array<long>, seq binary"
    long, longs = pa.int64(), pa.list_(pa.int64())
    kind = pa.schema({"a": long, "b": long, "counts": long} if last else {"block": long, "own": pa.int32(), "a": longs, "b": longs, "counts": longs, "seq": pa.binary()})
    small_batches(rows)
    named = items.select(F.col("block").alias("of"), "no", "id").groupBy("of")
    return rows.select("block", "own", "seq", "size").groupBy("block").cogroup(named).applyInArrow(run, schema)


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to most_words words that occur ``least`` times, and (lang, n).

    Phrases are (lang, len, id, words, a, first, last, heads, tails): a is the
    count, first and last the ids of all but the last and all but the first word,
    heads and tails the counts of the first and of the last 1, 2, ... words.
    """
    shelf = Shelf(docs.sparkSession, "phrases")
    none, longs = F.lit(None).cast("long"), F.array().cast("array<long>")
    made = shelf.put(blocks(docs, text_col, lang_col, most_words, block_words), "blocks", long_rows=True)
    words = made.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("no", "x")).select("block", "lang", "no", F.col("x.words").alias("word"), "x.counts")
    counted = shelf.put(words.groupBy("lang", "word").agg(F.sum("counts").alias("a")), "counts")
    sizes = shelf.put(counted.groupBy("lang").agg(F.sum("a").alias("n")), "sizes")
    level = counted.where(F.col("a") >= least).select("lang", F.lit(1).alias("len"), F.monotonically_increasing_id().alias("id"), F.array("word").alias("words"), "a")
    found = [shelf.put(level.withColumns({"first": none, "last": none, "heads": longs, "tails": longs}), "level1")]
    items = words.join(found[0].select("lang", F.col("words")[0].alias("word"), "id"), ["lang", "word"])
    rows = made.select("block", "own", "seq", F.size("words").alias("size"))
    for k in range(2, most_words + 1):
        pairs = paired(rows, items, k == most_words)
        if k < most_words:
            rows = shelf.put(pairs, "pairs", long_rows=True)
            shelf.drop("blocks", "counts")  # nothing reads them from here on
            pairs = rows.select("block", F.posexplode(F.arrays_zip("a", "b", "counts")).alias("no", "x")).select("block", "no", "x.a", "x.b", "x.counts")
        often = pairs.groupBy("a", "b").agg(F.sum("counts").alias("count")).where(F.col("count") >= least)
        often = shelf.put(often.withColumn("id", F.monotonically_increasing_id()), "often")
        known = found[-1]
        heads = known.select("lang", F.col("id").alias("a"), F.col("words").alias("head"), F.concat("heads", F.array("a")).alias("heads"))
        tails = known.select(F.col("id").alias("b"), F.element_at("words", -1).alias("tail"), F.concat("tails", F.array("a")).alias("tails"))
        level = often.join(heads, "a").join(tails, "b").select(
            "lang", F.lit(k).alias("len"), "id", F.concat("head", F.array("tail")).alias("words"), F.col("count").alias("a"),
            F.col("a").alias("first"), F.col("b").alias("last"), "heads", "tails",
        )
        found.append(shelf.put(level, f"level{k}"))
        if k < most_words:
            items = pairs.join(often, ["a", "b"])
            rows = rows.select("block", "own", "seq", F.size("a").alias("size"))
    shelf.clear("sizes", *(f"level{k}" for k in range(1, most_words + 1)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, sizes


def scored(known: DataFrame) -> DataFrame:
    """Phrases of two words and more with l, r and score of their lowest-scoring cut, of equal ones that after the fewest words."""
    square = f"CAST(CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(18,0)) AS DECIMAL(38,0)) * {SCALE}BD"
    parts = "CAST(get(heads, k - 1) AS DECIMAL(19,0)) * CAST(get(tails, len - k - 1) AS DECIMAL(18,0))"
    cut = F.expr(f"array_min(transform(sequence(1, len - 1), k -> struct(({square}) div ({parts}) AS score, k AS k, get(heads, k - 1) AS l, get(tails, len - k - 1) AS r)))")
    return known.where("len > 1").withColumn("cut", cut).select("lang", "len", "id", "words", "a", "first", "last", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, cover: int = COVER, top: int = 2000, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases that no longer one covers by ``cover`` percent.

    A longer phrase that holds one within is no more frequent than those that hold
    it and are one word longer, so only these, which point to it, are looked at.
    """
    known, sizes = phrases(docs, text_col, lang_col, most_words, least, block_words)
    rows = scored(known)
    above = rows.where("len > 2").select((F.col("len") - 1).alias("len"), F.explode(F.array("first", "last")).alias("id"), F.col("a").alias("longer")).groupBy("len", "id").agg(F.max("longer").alias("longer"))
    kept = rows.join(above, ["len", "id"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents
), p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM t)),
o AS (
  SELECT lang, k, CASE k WHEN 1 THEN w[i] WHEN 2 THEN w[i] || ' ' || w[i + 1] ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS phrase, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a, any_value(w1) AS w1, any_value(CASE WHEN k > 1 THEN w2 END) AS w2, any_value(CASE WHEN k > 2 THEN w3 END) AS w3 FROM o GROUP BY lang, k, phrase
), n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT lang, k, phrase, a, w1, w2, w3, 1 AS cut, w1 AS lp, CASE k WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS rp FROM c
  UNION ALL SELECT lang, k, phrase, a, w1, w2, w3, 2, w1 || ' ' || w2, w3 FROM c WHERE k = 3
), s AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.cut, l.a AS l, r.a AS r,
    CAST((CAST(x.a AS HUGEINT) * x.a * 1000000) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp AND l.k = x.cut JOIN f r ON r.lang = x.lang AND r.phrase = x.rp AND r.k = x.k - x.cut
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
v AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE k = 3
  ) GROUP BY lang, phrase
), kept AS (SELECT b.* FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase AND b.k = 2 WHERE v.longer IS NULL OR 100 * v.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

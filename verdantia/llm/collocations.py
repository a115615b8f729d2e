"""Mining of collocations by prefix-free parsing (operator 11).

A text's words are parsed into chunks: a chunk starts at the text's first word and wherever the key of the next WINDOW words is
divisible by MOD, and reaches through the window of the next start. So chunks overlap by WINDOW words, equal passages give
equal chunks wherever they stand, and every phrase of up to WINDOW + 1 words lies within the chunk that owns its first word,
and is counted there only. Distinct chunks form the dictionary, with their frequency in the parse; phrases are counted inside
the dictionary's chunks, weighted by it.

Words are counted first, then the keys of pairs of words that are both frequent enough, then all longer phrases of which every
pair's key is: a phrase is no more frequent than its parts. Equal pairs have equal keys, so a key is no rarer than its pair.
Membership is asked of a bitmap of hashed keys, which may let a phrase through that will be dropped by its exact count, but never
stops one. Its size follows the number of frequent keys up to a bound; beyond, it stops less and the counts stay the same.

Null text is empty and null language 'und'; equal rows are separate documents; texts are parsed whole, in blocks of a few MB or
one long text (a long text without starts is one chunk); phrases with equal score and count are ranked by their bytes; an
empty table gives an empty result; other columns are ignored. Counts are of strings, so that hashes decide nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, cut, mix, short_batches
from .tokens import blocks, coded, codes, gather, keys_of, runs, strings

LONGEST, LEAST, TOP = 5, 100, 2000
WINDOW, MOD = LONGEST - 1, 32
#: Bytes that end a piece, and bytes of words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\v\f\r"]] = True
WORD = ~BREAK
WORD[[*b" \t"]] = False
#: Bytes of chunks in which equal phrases are added up before they leave Python.
BLOCK = 4 << 20
#: Bits of a bitmap of keys: FEW to MANY (128 MB), about SPARE for each key.
FEW, MANY, SPARE = 20, 30, 32
#: Fixed value: an odd multiplier that tells the places of a phrase apart.
PLACE = U64(0xD6E8FEB86659FD93)


def joined(keys: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """The key of phrases from the keys of their words and language."""
    out = mix(lang)
    for k in keys:
        out = mix(out * PLACE + k)
    return out


def parse(batches):
    """(lang, owned, chunk): the first `owned` words of a chunk start phrases that are counted in it."""
    for rows, buf, off in blocks(batches, "text"):
        s, e, row = runs(WORD[buf], off)
        m = len(s)
        if not m:
            continue
        code, distinct = coded(buf, s, e)
        key = keys_of(distinct)[code]
        start = np.append(True, row[1:] != row[:-1])
        if m >= WINDOW:
            ahead = [key[i : m - WINDOW + 1 + i] for i in range(WINDOW)]
            hit = joined(ahead, np.zeros(1, U64)) % U64(MOD) == 0
            hit &= row[: m - WINDOW + 1] == row[WINDOW - 1 :]
            start[: m - WINDOW + 1] |= hit
        first = np.flatnonzero(start)
        after = np.append(first[1:], m)
        end = np.append(np.flatnonzero(row[1:] != row[:-1]), m - 1)[row_rank(row)[first]]  # the last word of the text
        last = np.minimum(after - 1 + WINDOW, end)
        lang = rows.column("lang").combine_chunks().take(pa.array(row[first]))
        yield pa.record_batch([lang, pa.array((after - first).astype(np.int32)), strings(*gather(buf, s[first], e[last]))], ["lang", "owned", "chunk"])


def row_rank(row: np.ndarray) -> np.ndarray:
    """0, 1, ... for the distinct values of an ascending array."""
    return np.cumsum(np.append(False, row[1:] != row[:-1]))


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, owned, chunk, freq): distinct chunks and how often the parse has them."""
    found = docs.mapInArrow(parse, "lang string, owned int, chunk string")
    return found.groupBy("lang", "owned", "chunk").agg(F.count("*").alias("freq"))


def asked(parts, bits: int):
    """Whether keys are in the broadcast bitmap `parts`."""
    there = np.frombuffer(parts.value, np.uint8)

    def known(key: np.ndarray) -> np.ndarray:
        at = (key >> U64(64 - bits)).astype(np.int64)
        return (there[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return known


def placed(rows, buf: np.ndarray, off: np.ndarray):
    """Of a block of chunks: (start, end, row, code, distinct words, lang code, langs, freq, mine, tied) of its words.

    mine: the word starts phrases here; tied: no piece ends between a word and the next.
    """
    s, e, row = runs(WORD[buf], off)
    code, distinct = coded(buf, s, e)
    lang, langs = codes(rows.column("lang"))
    freq, owned = (rows.column(c).to_numpy().astype(np.int64) for c in ("freq", "owned"))
    mine = np.arange(len(s)) - np.searchsorted(row, np.arange(len(off) - 1))[row] < owned[row]
    ends = np.cumsum(np.append(0, BREAK[buf]).astype(np.int32))
    tied = (row[1:] == row[:-1]) & (ends[s[1:]] == ends[e[:-1]])
    return s, e, row, code, distinct, lang[row], langs, freq[row], mine, tied


def added(name: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct name, the sum of freq where it stands)."""
    order = np.argsort(name, kind="stable")
    new = np.flatnonzero(np.append(True, name[order[1:]] != name[order[:-1]]))
    return order[new], np.add.reduceat(freq[order], new)


def pair_counts(parts, bits: int):
    """(key, f) of the pairs of frequent words in every block of chunks; parts: a bitmap of frequent words."""

    def run(batches):
        known = asked(parts, bits)
        for rows, buf, off in blocks(batches, "chunk", BLOCK):
            _, _, _, code, distinct, lang, langs, freq, mine, tied = placed(rows, buf, off)
            key, lang_key = keys_of(distinct)[code], keys_of(pa.array(langs, pa.string()))[lang]
            one = known(joined([key], lang_key))
            at = np.flatnonzero(mine[:-1] & tied & one[:-1] & one[1:]) if len(code) > 1 else np.zeros(0, np.int64)
            if len(at):
                pair = joined([key[at], key[at + 1]], lang_key[at])
                spot, f = added(pair, freq[at])
                yield pa.record_batch([pa.array(pair[spot].view(np.int64)), pa.array(f)], ["key", "f"])

    return run


def counts(sizes: tuple[int, ...], parts, bits: int):
    """(lang, phrase, f) of the phrases of `sizes` words in every block of chunks, once for each distinct one.

    parts: None, or a bitmap that holds all frequent pairs.
    """

    def run(batches):
        known = None if parts is None else asked(parts, bits)
        for rows, buf, off in blocks(batches, "chunk", BLOCK):
            s, e, row, code, distinct, lang, langs, freq, mine, tied = placed(rows, buf, off)
            m = len(s)
            if not m:
                continue
            if known is not None:
                key, lang_key = keys_of(distinct)[code], keys_of(pa.array(langs, pa.string()))[lang]
                pair = np.flatnonzero(tied)
                tied[pair] = known(joined([key[pair], key[pair + 1]], lang_key[pair]))
            ok, name = mine, lang * len(distinct) + code  # name: equal where the first words and language are
            for size in range(1, max(sizes) + 1):
                if size > 1:
                    at = np.flatnonzero(ok[: m - size + 1] & tied[size - 2 :])
                    ok = np.zeros(m, bool)
                    ok[at] = True
                    short = name[at] if size == 2 else np.unique(name[at], return_inverse=True)[1]
                    name = np.full(m, -1, np.int64)
                    name[at] = short * len(distinct) + code[at + size - 1]
                if size not in sizes:
                    continue
                at = np.flatnonzero(ok)
                if not len(at):
                    break
                spot, f = added(name[at], freq[at])
                at = at[spot]
                yield pa.record_batch([pa.array(langs, pa.string()).take(pa.array(lang[at])), phrases(buf, s, e, at, size), pa.array(f)], ["lang", "phrase", "f"])

    return run


def phrases(buf: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The n words from each place on, with one space between."""
    each = (at[:, None] + np.arange(n)).ravel()
    if n == 1:
        return strings(*gather(buf, s[each], e[each]))
    size = e[each] - s[each] + 1  # with a byte for the space
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    from_ = np.repeat(s[each] - out[:-1], size)
    from_ += np.arange(out[-1])
    data = buf[np.minimum(from_, len(buf) - 1)]
    data[out[1:] - 1] = 32
    keep = np.ones(len(data), bool)
    keep[out[n::n] - 1] = False  # no space after the last word
    return strings(data[keep], out[::n] - np.arange(len(at) + 1))


def frequent(chunks: DataFrame, least: int, sizes: tuple[int, ...], known=(None, 0)) -> DataFrame:
    """(lang, phrase, f) of the phrases of `sizes` words with f of `least` at least; known: a bitmap of pairs and its bits."""
    found = chunks.mapInArrow(counts(sizes, *known), "lang string, phrase string, f long")
    return cut(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least))


def word_keys(batches):
    for b in batches:
        if b.num_rows:
            lang, word = (keys_of(c.cast(pa.string())) for c in b.columns)
            yield pa.record_batch([pa.array(joined([word], lang).view(np.int64))], ["key"])


def bitmap(keys: DataFrame):
    """(broadcast bitmap, bits of a key that place it): built by partial aggregates of 4 kB each, at most 2**MANY bits."""
    spark = keys.sparkSession
    bits = min(MANY, max(FEW, int(keys.count() * SPARE).bit_length()))
    at = F.shiftrightunsigned("key", 64 - bits) + 1
    made = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(1 << bits >> 3)
    for r in made.toLocalIterator():
        first = (r.bucket - 1) * 4096
        out[first : first + 4096] = r.bits
    return spark.sparkContext.broadcast(bytes(out)), bits


def scored(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from (lang, phrase, f) of all frequent phrases and (lang, n)."""
    words = F.split("phrase", " ")
    many = found.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
    text = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("left"), text(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("cast(a as decimal(18,0)) * cast(n as decimal(16,0)) * cast(1000 as decimal(4,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: text(i, n))))
    inner = many.filter(F.size("w") > 2).select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = best.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(F.col("longer") >= F.col("a"), F.lit(False)))  # 100 * f(longer) >= 100 * a
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    kept = stay.withColumn("rank", rank).filter(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of 2 to LONGEST words of every language."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chunks = cut(dictionary(short_batches(docs)))
    totals = cut(chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("freq")).alias("n")))
    one = frequent(chunks, least, (1,))
    words = bitmap(one.select("lang", "phrase").mapInArrow(word_keys, "key long"))
    pairs = cut(chunks.mapInArrow(pair_counts(*words), "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select("key"))
    more = frequent(chunks, least, tuple(range(2, LONGEST + 1)), bitmap(pairs))
    return scored(one.unionByName(more), totals, top)


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE i + size - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scores AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + size2 - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, size, w, size2, unnest(range(1, size - size2 + 2)) AS i FROM cand, (SELECT unnest([2, 3, 4]) AS size2) WHERE size2 < size) GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))

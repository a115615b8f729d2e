"""Audit of how far sources diverge in their words (operator 13), by a recount through minimal perfect hashes.

The first pass counts, exactly, the documents of each language that hold a term, and keeps terms with enough of them. The
kept terms of a language are dealt by hash into shards; each shard becomes a minimal perfect hash (levels of bits, where a key
alone at its position is placed) that stores its terms in slot order. Shards are broadcast, as many at once as a fixed
number of bytes holds; further ones take a pass each. The second pass looks every term up, compares it with the one stored
at its slot, and increments dense slots of its (language, source) group, which leave a task as sums. Probabilities, and
the distances of them, are integers.

Null text, language and source are ''. Texts are read whole, in blocks of a few MB or one long text; equal rows are separate
documents; equal values are ranked by item; a language without kept terms has distances 0 and no terms; an empty table gives
an empty result; other columns are ignored. Exact up to 9 * 10**15 terms of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, cut, mix, short_batches
from .tokens import blocks, coded, codes, keys_of, runs

#: Bytes of terms: letters of ASCII and all bytes of other characters.
TERM = np.zeros(256, bool)
TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LEAST_DOCS, TOP, SCALE, ADD = 30, 50, 1_000_000_000, 5
#: Terms of a shard, about, and bytes of shards that are broadcast at once.
SHARD, AT_ONCE = 1 << 15, 64 << 20
#: Bytes of dense slots that a task holds before they leave it.
SLOTS = 64 << 20
#: Terms and sources whose distances are summed in one group.
TERM_TILE, SOURCE_TILE = 512, 256
LEVELS = 40


class PerfectHash:
    """A minimal perfect hash of distinct terms, which it stores in the order of their slots."""

    def __init__(self, levels: list[np.ndarray], terms: pa.Array):
        self.levels, self.terms = levels, terms
        self.ranks, at = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(at + np.cumsum(ones) - ones)
            at += int(ones.sum())
        self.placed = at
        #: terms whose 64-bit keys are equal stand last, and are told apart by themselves
        self.rest = terms.slice(at)

    @classmethod
    def build(cls, terms: pa.Array) -> PerfectHash:
        keys, left, levels, slots, at = keys_of(terms), np.arange(len(terms)), [], np.zeros(len(terms), np.int64), 0
        while len(left) and len(levels) < LEVELS:
            size = -(-2 * len(left) // 64) * 64
            pos = cls.position(keys[left], len(levels), size)
            alone = np.bincount(pos, minlength=size)[pos] == 1
            mark = np.zeros(size, np.uint8)
            mark[pos[alone]] = 1
            bits = np.packbits(mark, bitorder="little").view(U64)
            slots[left[alone]] = at + np.cumsum(mark)[pos[alone]] - 1
            at += int(alone.sum())
            left = left[~alone]
            levels.append(bits)
        slots[left] = at + np.arange(len(left))
        order = np.empty(len(terms), np.int64)
        order[slots] = np.arange(len(terms))
        return cls(levels, terms.take(pa.array(order)))

    @staticmethod
    def position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(size)).astype(np.int64)

    def slots(self, terms: pa.Array, keys: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for terms that the hash doesn't store."""
        out, left = np.full(len(terms), -1, np.int64), np.arange(len(terms))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            pos = self.position(keys[left], level, len(bits) * 64)
            word, bit = bits[pos >> 6], (pos & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = word & ((U64(1) << bit) - U64(1))
            out[left[hit]] = (rank[pos >> 6] + np.bitwise_count(below))[hit]
            left = left[~hit]
            if not len(left):
                break
        placed = np.flatnonzero(out >= 0)
        same = pc.equal(self.terms.take(pa.array(out[placed])), terms.take(pa.array(placed))).to_numpy(zero_copy_only=False)
        out[placed[~same.astype(bool)]] = -1
        if len(self.rest):
            at = pc.index_in(terms, self.rest).to_numpy(zero_copy_only=False)
            extra = np.flatnonzero(~np.isnan(at.astype(float)))
            out[extra] = self.placed + at[extra].astype(np.int64)
        return out


def document_counts(batches):
    """(lang, term, docs) of every block: documents of a language that hold a term."""
    for rows, buf, off in blocks(batches, "text"):
        s, e, row = runs(TERM[buf], off)
        if not len(s):
            continue
        code, terms = coded(buf, s, e)
        lang, langs = codes(rows.column("lang"))
        once = np.unique(code * len(lang) + row)
        both, n = np.unique(lang[once % len(lang)] * len(terms) + once // len(lang), return_counts=True)
        yield pa.record_batch([pa.array(langs).take(pa.array(both // len(terms))), terms.take(pa.array(both % len(terms))), pa.array(n)], ["lang", "term", "docs"])


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    found = docs.select("lang", "text").mapInArrow(document_counts, "lang string, term string, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term")


def dealt(batches):
    """Names the shard of each term by its key, as find() does."""
    for b in batches:
        if b.num_rows:
            term = b.column(1).cast(pa.string())
            yield pa.record_batch([b.column(0), term, pa.array(shard_of(keys_of(term), b.column(2).to_numpy()))], ["lang", "term", "shard"])


def shard_of(keys: np.ndarray, many) -> np.ndarray:
    return ((keys >> U64(32)) * np.asarray(many).astype(U64) >> U64(32)).astype(np.int32)


def build_shard(key: tuple, table: pa.Table) -> pa.Table:
    made = PerfectHash.build(table.column("term").combine_chunks().cast(pa.string()))
    levels = [x.tobytes() for x in made.levels]
    size = sum(map(len, levels)) + made.terms.nbytes
    cols = {"lang": [key[0].as_py()], "shard": [key[1].as_py()], "n": [len(made.terms)], "bytes": [size], "levels": [levels], "terms": [made.terms.to_pylist()]}
    return pa.table(cols, pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("bytes", pa.int64()), ("levels", pa.list_(pa.binary())), ("terms", pa.list_(pa.string()))]))


def shards(kept: DataFrame, most: int) -> DataFrame:
    """(lang, shard, n, bytes, levels, terms): the perfect hashes, a row each, of about `most` terms."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / most).cast("long").alias("many"))
    named = kept.join(sizes, "lang").select("lang", "term", "many").mapInArrow(dealt, "lang string, term string, shard int")
    return named.groupBy("lang", "shard").applyInArrow(build_shard, "lang string, shard int, n long, bytes long, levels array<binary>, terms array<string>")


def recount(hashes, many: dict):
    """A pass over (lang, source, text): sums for (lang, source, slot), by dense slots of each group.

    hashes: a broadcast of {lang: {shard: (first slot, levels, terms)}}; many: the shards of each language.
    """

    def run(batches):
        known = {lang: {k: (first, PerfectHash([np.frombuffer(x, U64) for x in levels], pa.array(terms, pa.string()))) for k, (first, levels, terms) in own.items()} for lang, own in hashes.value.items()}
        size = {lang: max(first + len(h.terms) for first, h in own.values()) for lang, own in known.items()}
        low = {lang: min(first for first, _ in own.values()) for lang, own in known.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def out():
            for (lang, source), n in dense.items():
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(at + low[lang]), pa.array(n[at])], ["lang", "source", "slot", "n"])
            dense.clear()

        for rows, buf, off in blocks(batches, "text"):
            s, e, row = runs(TERM[buf], off)
            if not len(s):
                continue
            code, terms = coded(buf, s, e)
            keys = keys_of(terms)
            lang, langs = codes(rows.column("lang"))
            source, sources = codes(rows.column("source"))
            both, n = np.unique((lang[row] * len(sources) + source[row]) * len(terms) + code, return_counts=True)
            group, code = both // len(terms), both % len(terms)
            for i, name in enumerate(langs):
                if name not in known:
                    continue
                lo, hi = np.searchsorted(group, [i * len(sources), (i + 1) * len(sources)])
                used = np.unique(code[lo:hi])
                slot = np.full(len(terms), -1, np.int64)
                slot[used] = find(known[name], many[name], terms.take(pa.array(used)), keys[used])
                for g in np.unique(group[lo:hi]):
                    a, b = np.searchsorted(group, [g, g + 1])
                    at = slot[code[a:b]]
                    key = (name, sources[g % len(sources)])
                    if key not in dense:
                        if sum(x.nbytes for x in dense.values()) > SLOTS:
                            yield from out()
                        dense[key] = np.zeros(size[name] - low[name], np.int64)
                    dense[key][at[at >= 0] - low[name]] += n[a:b][at >= 0]  # codes are distinct here, and so are slots
        yield from out()

    return run


def find(own: dict, many: int, terms: pa.Array, keys: np.ndarray) -> np.ndarray:
    """Slots of terms in those shards of a language that are at hand; -1 for all others."""
    out, shard = np.full(len(terms), -1, np.int64), shard_of(keys, many)
    for k, (first, made) in own.items():
        here = np.flatnonzero(shard == k)
        at = made.slots(terms.take(pa.array(here)), keys[here])
        out[here[at >= 0]] = first + at[at >= 0]
    return out


def counted(docs: DataFrame, made: DataFrame, at_once: int) -> tuple[DataFrame, DataFrame]:
    """(counts (lang, source, slot, n), first slots (lang, shard, first)): passes over docs, each with at most at_once bytes of shards."""
    spark = docs.sparkSession
    sizes = made.select("lang", "shard", "n", "bytes").orderBy("lang", "shard").collect()  # a row for each SHARD terms
    passes, first, held, many = [[]], {}, 0, {}
    place: dict[str, int] = {}
    for r in sizes:
        if passes[-1] and held + r.bytes > at_once:
            passes.append([])
            held = 0
        passes[-1].append((r.lang, r.shard))
        held += r.bytes
        first[r.lang, r.shard] = place.get(r.lang, 0)
        place[r.lang] = place.get(r.lang, 0) + r.n
        many[r.lang] = many.get(r.lang, 0) + 1
    firsts = spark.createDataFrame([(*k, v) for k, v in first.items()], "lang string, shard int, first long")
    schema = "lang string, source string, slot long, n long"
    out = spark.createDataFrame([], schema)
    for names in passes if sizes else []:
        some = made if len(passes) == 1 else made.join(F.broadcast(spark.createDataFrame(names, "lang string, shard int")), ["lang", "shard"], "left_semi")
        held_now: dict = {}
        for r in some.collect():  # at most at_once bytes, or one shard
            held_now.setdefault(r.lang, {})[r.shard] = (first[r.lang, r.shard], [bytes(x) for x in r.levels], r.terms)
        found = docs.mapInArrow(recount(spark.sparkContext.broadcast(held_now), many), schema)
        out = out.unionByName(found.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")))
    return out, firsts


def scaled(n: str, of: str) -> Column:
    """1 + floor(SCALE * (n + ADD) / of), exactly."""
    return F.expr(f"1 + cast({n} + {ADD} as decimal(20,0)) * cast({SCALE} as decimal(10,0)) div cast({of} as decimal(20,0))")


def scaled_array(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The same by long division, as the product may pass 64 bits; of below 9 * 10**15."""
    q, r = np.divmod(n + ADD, of)
    for _ in range(3):
        step, r = np.divmod(r * 1000, of)
        q = q * 1000 + step
    return q + 1


def distances(wide: int):
    """For a tile of terms and two tiles of `wide` sources: (lang, i, j, value) of their pairs i < j.

    Rows (place, of, at, n) hold counts above 0; each source has a row without a slot too.
    """

    def run(table: pa.Table) -> pa.Table:
        lang, tile, other, width = (table.column(c)[0].as_py() for c in ("lang", "tile", "other", "width"))
        place, slot, n, of = (table.column(c).to_numpy() for c in ("place", "at", "n", "of"))
        full = slot >= 0
        counts, total = np.zeros((2 * wide, width), np.int64), np.ones(2 * wide, np.int64)
        row = place % wide + np.where(place // wide == tile, 0, wide)
        counts[row[full], slot[full]] = n[full]
        total[row] = of
        p = scaled_array(counts, total[:, None])
        left, right = (np.unique(place[place // wide == t]) for t in (tile, other))
        found = []
        for i in left:
            later = right[right > i]
            gap = np.abs(p[later % wide + (0 if other == tile else wide)] - p[i % wide]).sum(axis=1)
            found.append((np.full(len(later), i), later, gap))
        i, j, value = (np.concatenate(x) for x in zip(*found))
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "i": i, "j": j, "value": value})

    return run


def pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): distances of every two sources of a language.

    groups (lang, source, v, of) holds kept terms and denominators. Sources and terms are dealt into tiles, so that no task
    holds more than SOURCE_TILE x TERM_TILE slots twice; each count is sent once for each tile of sources of its language.
    """
    named = cut(groups.withColumn("place", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")))
    tiles = named.groupBy("lang").agg(F.floor(F.max("place") / SOURCE_TILE).alias("last"))
    there = named.filter("v > 0").join(tiles, "lang").select("lang", "source", "v", "of", "place", "last")
    blank = there.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("v") - 1) / TERM_TILE))))
    blank = blank.select("lang", "v", "of", "place", "last", "block", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    full = counts.join(there, ["lang", "source"]).select("lang", "v", "of", "place", "last", F.floor(F.col("slot") / TERM_TILE).alias("block"), (F.col("slot") % TERM_TILE).alias("at"), "n")
    mine = F.floor(F.col("place") / SOURCE_TILE)
    rows = blank.unionByName(full).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.select("lang", "block", F.least(mine, "with").alias("tile"), F.greatest(mine, "with").alias("other"), "place", "at", "n", "of", F.least(F.lit(TERM_TILE), F.col("v") - F.col("block") * TERM_TILE).alias("width"))
    sums = rows.groupBy("lang", "block", "tile", "other").applyInArrow(distances(SOURCE_TILE), "lang string, i long, j long, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    a = named.select("lang", "source", F.col("place").alias("i"))
    b = named.select("lang", F.col("source").alias("item"), F.col("place").alias("j"))
    return a.join(b, "lang").filter("i != j").join(both, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, shard: int = SHARD, at_once: int = AT_ONCE, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances to other sources, and the terms that a source uses above its language."""
    void = F.lit("")
    docs = short_batches(docs.select(F.coalesce(F.col(lang).cast("string"), void).alias("lang"), F.coalesce(F.col(source).cast("string"), void).alias("source"), F.coalesce(F.col(text).cast("string"), void).alias("text")))
    made = cut(shards(cut(kept_terms(docs, least)), shard))
    counts, firsts = counted(docs, made, at_once)
    counts = cut(counts)
    vocabulary = made.join(firsts, ["lang", "shard"]).select("lang", "first", F.posexplode("terms").alias("pos", "term")).select("lang", (F.col("first") + F.col("pos")).alias("slot"), "term")
    size = made.groupBy("lang").agg(F.sum("n").alias("v"))
    groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.coalesce("n", F.lit(0).cast("long")).alias("total"))
    groups = cut(groups.withColumn("of", F.col("total") + ADD * F.col("v")))
    whole = groups.groupBy("lang").agg((F.sum("total") + ADD * F.first("v")).alias("lang_of"))

    by_value = [F.desc("value"), F.asc("item")]
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(*by_value))
    pair = pairs(counts, groups).withColumn("rank", rank)
    every = counts.groupBy("lang", "slot").agg(F.sum("n").alias("all"))
    terms = counts.join(groups.select("lang", "source", "of"), ["lang", "source"]).join(every, ["lang", "slot"]).join(whole, "lang")
    terms = terms.withColumn("value", scaled("n", "of") - scaled("`all`", "lang_of")).filter("value > 0")
    terms = terms.join(vocabulary, ["lang", "slot"]).select("lang", "source", F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return shown(pair, "pair").unionByName(shown(terms, "term"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
found AS (SELECT row, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
hits AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN hits USING (lang, source, term)),
scored AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM cells JOIN sizes USING (lang)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM scored a JOIN scored b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM scored WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))

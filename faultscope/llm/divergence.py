r"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

Kept terms (Iceberg prefix refinement): level by level the prefixes get longer (``FIRST`` bytes,
then twice as many each time). A level reads the documents once and counts, for each (lang, prefix), the documents that hold a term with that prefix,
under prefixes that survived the level before; prefixes in fewer than ``least`` documents are
discarded with all terms below them. A term that is no longer than the level's width counts as a
complete one (marked by a blank behind it) and is kept or discarded for good. The levels end when
no incomplete prefix is left, so rounds grow with the logarithm of the longest kept term.

Survivors reach the tasks as a bitmap of their hashes, of fixed size (``BITS``) whatever their
number. A false hit costs some counting and changes nothing: every prefix that is counted is
counted over all documents, and a prefix below a discarded one cannot reach the threshold.

Divergence: counts of kept terms by (lang, source) are added up; p and f are exact integers
(decimals where a product may pass 64 bits). The value of a pair of sources is summed over all
kept terms without spelling out absent ones: a term that one source lacks depends on the other's
count alone, so each source gives a histogram of its counts, and terms that both hold are
corrected one by one: tasks turn the list of a term's sources into partial sums of pairs.

Each row is a document. Result: one row per (lang, source, part, item). Edge cases: null text,
lang and source are read as ''; texts without terms leave their group in place; a lang without
kept terms has its pairs with value 0; a single source has no pairs; repeated rows count each;
long texts and long terms are counted whole; ties go to the smaller item by UTF-8; extra columns
are ignored; an empty table gives no rows.

Hot groups: all counts combine in the task and again map-side; ranks to 10 are cut map-side. A
term's list has one entry a source, a source's pairs one row for each other source of the lang,
as many as the result itself has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import share, stored, table

LEAST, TOP, FIRST, BITS = 10, 10, 6, 1 << 26
SCALE = 1_000_000_000
#: Counts held by a task before they are handed on; bytes of text, cells of a table (8 bytes each) and pairs worked on at once.
#: A worker holds some 130 MB with them: several share an executor with the JVM.
HELD, SLICE, WIDE, CELLS, PAIRS = 100_000, 1 << 20, 1 << 22, 1 << 22, 1 << 20
_TERM = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def named_texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, text) without nulls."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def tokens(b: pa.RecordBatch, size: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, list[bytes]]]:
    """Runs of documents of one lang: lang, their sources, the document and the term of each occurrence, the terms.

    A run holds ``size`` bytes of text, or one document.
    """
    langs = b.column(0).dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        mine = pc.equal(langs.indices, k)
        text, source = b.column(2).filter(mine), b.column(1).filter(mine)
        upto, lo = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)), 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, "right")))
            part = pa.concat_arrays([text.slice(lo, hi - lo).cast(pa.large_string())])  # offsets from 0
            _, offsets, data = part.buffers()
            plain = pa.LargeStringArray.from_buffers(len(part), offsets, pa.py_buffer(data.to_pybytes().translate(_TERM) if data else b""))
            words = pc.ascii_split_whitespace(plain)
            coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
            doc = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            yield lang, source.slice(lo, hi - lo), doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            lo = hi


def documents_of(doc: np.ndarray, place: np.ndarray, docs: int, places: int) -> np.ndarray:
    """For each place the number of documents that hold it: one bit table if it is small, else a sort."""
    key = doc * places + place
    if docs * places <= CELLS:
        seen = np.zeros(docs * places, bool)
        seen[key] = True
        return seen.reshape(docs, places).sum(0)
    return np.bincount(np.unique(key) % places, minlength=places)


def tally(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, with their numbers."""
    if size <= CELLS:
        n = np.bincount(key, minlength=1)
        return np.flatnonzero(n), n[n > 0]
    return np.unique(key, return_counts=True)


def _key(prefix: str | Column) -> Column:
    return F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), prefix)


class Survivors:
    """A bitmap of hashes; ``in`` may be wrong for prefixes that were discarded, never for survivors."""

    def __init__(self, places: np.ndarray, words: np.ndarray, bits: int):
        self.cut = bits - 1
        self.map = np.zeros(bits >> 6, np.int64)
        self.map[places] = words
        self.map = self.map.tobytes()

    def __contains__(self, key: bytes) -> bool:
        at = xxhash.xxh64_intdigest(key, 42) & self.cut
        return self.map[at >> 3] >> (at & 7) & 1 == 1


def survivors(prefixes: DataFrame, bits: int) -> Survivors:
    """From (lang, prefix); at most ``bits`` / 64 rows reach the driver."""
    at = F.xxhash64(_key("prefix")).bitwiseAND(F.lit(bits - 1))  # XXH64 with seed 42
    rows = (prefixes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("word")).toArrow())
    return Survivors(rows["place"].to_numpy(), rows["word"].to_numpy(), bits)


def count_prefixes(texts: DataFrame, before: int, width: int, alive) -> DataFrame:
    """(lang, prefix, n): documents that hold a term with the prefix; ``alive`` is a broadcast or None."""
    schema = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("n", pa.int64())])

    def prefix_of(term: bytes, lang: bytes, survived) -> bytes | None:
        if len(term) <= before or (survived is not None and lang + term[:before] not in survived):
            return None
        return term[:width] if len(term) > width else term + b" "

    def run(batches):
        held: dict[str, dict[bytes, int]] = {}
        survived = alive.value if alive else None

        def emit():
            for lang, n in held.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.array(n, pa.binary()), pa.array(n.values(), pa.int64())], schema=schema)
            held.clear()

        for b in batches:
            for lang, source, doc, term, terms in tokens(b, SLICE):
                number: dict[bytes | None, int] = {None: 0}
                head = lang.encode() + b"\0"
                place = np.fromiter((number.setdefault(prefix_of(t, head, survived), len(number)) for t in terms), np.int64, len(terms))[term]
                here = place > 0
                times = documents_of(doc[here], place[here], len(source), len(number)).tolist()
                n = held.setdefault(lang, {})
                for p, c in zip(list(number)[1:], times[1:], strict=True):
                    n[p] = n.get(p, 0) + c
                if sum(map(len, held.values())) > HELD:
                    yield from emit()
        yield from emit()

    return texts.select("lang", "source", "text").mapInArrow(run, "lang string, prefix binary, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def kept_terms(texts: DataFrame, least: int = LEAST, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """(lang, term, n_docs) of the terms in at least ``least`` documents of the lang."""
    spark = texts.sparkSession
    before, width, alive, out = 0, first, None, None
    whole = F.expr("right(hex(prefix), 2) = '20'")
    while True:
        level = stored(count_prefixes(texts, before, width, alive).where(F.col("n") >= least).withColumn("whole", whole), "divergence-level")
        done = level.where("whole").select("lang", F.expr("substring(prefix, 1, octet_length(prefix) - 1)").cast("string").alias("term"), F.col("n").alias("n_docs"))
        out = done if out is None else out.unionByName(done)
        rest = level.where("NOT whole")
        if rest.isEmpty():
            return out
        alive = share(spark, survivors(rest, bits))
        before, width = width, 2 * width


def count_kept(texts: DataFrame, kept: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, source, term, n) of the kept terms that occur in the group."""
    may = share(texts.sparkSession, survivors(kept.select("lang", F.col("term").cast("binary").alias("prefix")), bits))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches):
        bits = may.value
        for b in batches:
            for lang, source, doc, term, terms in tokens(b, WIDE):
                head, coded = lang.encode() + b"\0", source.dictionary_encode()
                good = np.fromiter((head + t in bits for t in terms), bool, len(terms))[term]
                group = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc[good]]
                pairs, times = tally(group * len(terms) + term[good], len(coded.dictionary) * len(terms))
                if len(pairs):
                    names = pa.array(terms, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(pairs)), coded.dictionary.take(pa.array(pairs // len(terms))),
                                                      names.take(pa.array(pairs % len(terms))), pa.array(times.astype(np.int64))], schema=schema)

    part = texts.mapInArrow(run, "lang string, source string, term string, n long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept.select("lang", "term"), ["lang", "term"], "left_semi")


def share_of(count: str, total: str, terms: str) -> str:
    """p of a count, exact."""
    return f"1 + cast((cast({count} as decimal(20,0)) + 2) * {SCALE} div nullif(cast({total} as decimal(20,0)) + 2 * {terms}, 0) as bigint)"


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def shared_pairs(rows: DataFrame) -> DataFrame:
    """(lang, a, b, extra): over the terms that both sources hold, f less what the histograms count for them.

    ``rows`` has one row a term: lang, gid, p, p0 (arrays, one entry a source that holds it).
    """
    schema = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("extra", pa.int64())])

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def run(batches):
        for b in batches:
            ends, flat = np.asarray(b.column(1).offsets), [np.asarray(b.column(c).values) for c in (1, 2, 3)]
            base, stop = ends[0], np.repeat(ends[1:], np.diff(ends))
            langs, lang = np.unique(np.asarray(b.column(0).to_pylist(), object), return_inverse=True)
            lang = np.repeat(lang, np.diff(ends))
            at = np.arange(base, ends[-1])
            after = stop - at - 1  # partners behind each entry of its list
            upto = np.cumsum(after)
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
                n = after[lo:hi]
                x = np.repeat(at[lo:hi], n)
                if len(x):
                    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                    (gx, px, zx), (gy, py, zy) = ([c[k] for c in flat] for k in (x, y))
                    value = f(px, py) - f(px, zy) - f(zx, py) + f(zx, zy)
                    one, other = np.minimum(gx, gy), np.maximum(gx, gy)
                    order = np.lexsort((other, one))
                    one, other, value, who = one[order], other[order], value[order], lang[x - base][order]
                    first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (other[1:] != other[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(langs[who[first]], pa.string()), pa.array(one[first]), pa.array(other[first]), pa.array(np.add.reduceat(value, first))], schema=schema)
                lo = hi

    return rows.mapInArrow(run, "lang string, a long, b long, extra long").groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least: int = LEAST, top: int = TOP, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    texts = named_texts(docs, text_col, lang_col, source_col)
    kept = stored(kept_terms(texts, least, first, bits), "divergence-kept")
    counts = stored(count_kept(texts, kept, bits), "divergence-counts")
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    size = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = texts.select("lang", "source").distinct().join(by_lang, "lang", "left").join(size, ["lang", "source"], "left").select(
        F.monotonically_increasing_id().alias("gid"), "lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("v", "total", "held")])
    groups = stored(groups.withColumn("p0", F.expr(share_of("0", "total", "v"))), "divergence-groups")
    all_ = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    rows = stored(counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(share_of("n", "total", "v"))), "divergence-shares")

    whole = rows.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.collect_list(F.struct("gid", "p", "p0")).alias("held_by"))
    whole = stored(whole.join(all_, "lang").join(by_lang, "lang").withColumn("q", F.expr(share_of("lang_n", "lang_total", "v"))), "divergence-lang")
    term = rows.join(whole.select("lang", "term", "q"), ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))

    both = shared_pairs(whole.select("lang", *[F.col(f"held_by.{c}").alias(c) for c in ("gid", "p", "p0")]))
    bars = rows.groupBy("lang", "gid", "p").agg(F.count(F.lit(1)).alias("times"))
    other = groups.select("lang", F.col("gid").alias("b"), F.col("source").alias("b_source"), F.col("p0").alias("b_p0"), F.col("held").alias("b_held"))
    lone = bars.join(other, "lang").where("gid <> b").groupBy(F.col("gid").alias("a"), "b").agg(F.sum(F.expr("times * (" + gap("p", "b_p0") + ")")).alias("lone"))
    lone = stored(lone, "divergence-lone")
    pairs = groups.withColumnRenamed("gid", "a").join(other, "lang").where("a <> b")
    pairs = (pairs.join(lone, ["a", "b"], "left").join(lone.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("lone").alias("back")), ["a", "b"], "left")
             .join(both.select("a", "b", "extra").union(both.select("b", "a", "extra")), ["a", "b"], "left"))
    value = F.expr(f"coalesce(lone, 0) + coalesce(back, 0) + coalesce(extra, 0) + (v - held - b_held) * coalesce({gap('p0', 'b_p0')}, 0)")
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("b_source").alias("item"), F.when(F.col("v") > 0, value).otherwise(0).cast("bigint").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total, v.v
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS BIGINT) AS q FROM x
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""

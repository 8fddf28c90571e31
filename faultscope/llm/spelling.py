"""Spelling variant grouping: a frontier of trie states joined with a distributed edge table.

Words are counted in each task and added up by Spark. A pair of near words is found where the
first half of one of them is exact: the trie of the words serves edits in the second half, the
trie of the words read backwards those in the first half, so no state starts near the root,
where every word has nearly every sibling.

Edge table: (node, char, child), one row for each character of each word from its middle on and
one for its end mark. A node is a 64-bit hash of direction and prefix; two prefixes in one node
only add states, which the last join drops.

Frontier: states (word, position, node, edit). At each position of the second half a word starts
states with one edit: another character in its place (the smaller character walks, so a pair is
met once), or a character left out (of equal neighbours the last one). Both are joined with the
edges on (node, next character); a node has at most 91 children (a-z, U+00C0 to U+00FF,
the end mark), so no state has unbounded followers. Then the states advance one character a level, each level a join with the edge table
on (node, character); a state whose end mark was met is terminal. States that are still open
after ``LEVELS`` levels already name their target and go to the last join as they are. This
join with the words, on the spelled-out target, gives the neighbour and checks it.

Then each word takes its near word of largest count, and roots are found by doubling the
pointers: counts at least double at every step, so the chains are short and without circles.

Result: one row for each word. Edge cases: a null text has no words; a null id is read as
empty text in the hash; repeated rows count each; a word of any length is walked (a long one has
as many edges as characters); a run whose deletion leaves nothing is dropped; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stored, table

LETTERS, COUNT, RATIO, MODULUS = 5, 3, 2, 97
#: Levels walked one by one; what is open then is joined on its whole target.
LEVELS = 24
#: Runs and words held by a task before they are handed on.
HELD = 400_000
END = "$"
#: In Latin-1 a run is one of bytes that this table keeps; A-Z go to a-z, all else to blanks.
_RUN = bytes(c if 97 <= c <= 122 or c >= 0xC0 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_PRIME, _MASK, _HALF = 0x9E3779B97F4A7C15, (1 << 64) - 1, 1 << 63


def noised(doc_id: int | None, runs: set[bytes]) -> dict[bytes, bytes]:
    """The runs (Latin-1) of a document that lose a character, with what is left of them."""
    start = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    start = zlib.crc32(b":", start)
    out = {}
    for r in runs:
        h = zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), start)
        if not h % MODULUS:
            at = h % len(r)
            out[r] = r[:at] + r[at + 1:]
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word of at least ``LETTERS`` characters and ``COUNT`` places."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: dict[bytes, int] = {}

        def emit():
            some = {w: n for w, n in held.items() if len(w) >= LETTERS}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in some], pa.string()), pa.array(some.values(), pa.int64())], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs = text.encode("latin-1", "replace").translate(_RUN).split()
                for r in runs:
                    held[r] = held.get(r, 0) + 1
                moved = noised(doc_id, set(runs))
                if moved:
                    for r in runs:
                        if r in moved:
                            held[r] -= 1
                            held[moved[r]] = held.get(moved[r], 0) + 1
                if len(held) > HELD:
                    yield emit()
        yield emit()

    part = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


def paths(words: DataFrame) -> DataFrame:
    """(word, back, at, node, char, next, mid, after, drop): the steps of each word from its middle on.

    ``node`` lies before ``char``, ``mid`` behind it, ``after`` behind ``next`` as well; ``drop`` tells
    that leaving out ``char`` counts here. ``back`` is the trie of the words read backwards.
    """
    kinds = [("word", pa.string()), ("back", pa.bool_()), ("at", pa.int32()), ("node", pa.int64()), ("char", pa.string()), ("next", pa.string()), ("mid", pa.int64()), ("after", pa.int64()), ("drop", pa.bool_())]
    schema = pa.schema(kinds)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for word in b.column(0).to_pylist():
                for back in (False, True):
                    spelled = word[::-1] if back else word
                    size = len(word)
                    half = size - size // 2 if back else size // 2
                    nodes = [1 + back]
                    for c in spelled + END:
                        x = ((nodes[-1] ^ ord(c)) * _PRIME) & _MASK
                        nodes.append(x ^ (x >> 29))
                    same = half  # where the run of equal characters that holds this place starts, within the half
                    for at in range(half, size):
                        nxt = spelled[at + 1] if at + 1 < size else END
                        if at == half or spelled[at] != spelled[at - 1]:
                            same = at
                        whole = not back or same > half or half == 0 or spelled[half - 1] != spelled[half]
                        row = (word, back, at, nodes[at] - _HALF, spelled[at], nxt, nodes[at + 1] - _HALF, nodes[at + 2] - _HALF, nxt != spelled[at] and whole)
                        for col, v in zip(cols, row, strict=True):
                            col.append(v)
                    if len(cols[0]) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], schema=schema)
                        cols = [[] for _ in kinds]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], schema=schema)

    return words.select("word").mapInArrow(run, "word string, back boolean, at int, node long, char string, next string, mid long, after long, drop boolean")


def _spelled() -> Column:
    return F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))


def near_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, target) of every two words one edit apart, each pair once."""
    steps = stored(paths(words), "spelling-paths")
    twice = steps.select("node", "char", "next", "after").distinct()
    edges = stored(steps.select("node", "char", F.col("mid").alias("child")).union(steps.where(F.col("next") == END).select("mid", "next", "after")).distinct(), "spelling-edges")
    own = steps.select("word", "back", "at", "node", "char", "next", "drop")
    # One edit and the character behind it, in one join each.
    put = own.alias("a").join(twice.alias("b"), ["node", "next"]).where(F.col("b.char") > F.col("a.char")).select("word", "back", "at", F.col("b.char").alias("put"), F.col("after").alias("node"), (F.col("at") + 2).alias("pos"))
    cut = own.where("drop").join(edges.withColumnRenamed("char", "next"), ["node", "next"]).select("word", "back", "at", F.lit("").alias("put"), F.col("child").alias("node"), (F.col("at") + 2).alias("pos"))
    front = stored(put.unionByName(cut), "spelling-front")
    size = F.length("word")
    done = [front.where(F.col("pos") > size)]
    alive = front.where(F.col("pos") <= size)
    for _ in range(levels):
        char = F.when(F.col("pos") == size, F.lit(END)).otherwise(_spelled().substr(F.col("pos") + 1, F.lit(1)))
        moved = alive.withColumn("char", char).join(edges, ["node", "char"])
        front = stored(moved.select("word", "back", "at", "put", F.col("child").alias("node"), (F.col("pos") + 1).alias("pos")), "spelling-front")
        done.append(front.where(F.col("pos") > size))
        alive = front.where(F.col("pos") <= size)
        if alive.isEmpty():
            break
    else:
        done.append(alive)
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    target = F.concat(_spelled().substr(F.lit(1), F.col("at")), "put", _spelled().substr(F.col("at") + 2, size))
    found = ends.select("word", F.when(F.col("back"), F.reverse(target)).otherwise(target).alias("target"))
    return found.join(words.select(F.col("word").alias("target")), "target", "left_semi").select("word", "target")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; pointers double each round."""
    now = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stored(word_counts(docs, id_col, text_col), "spelling-words")
    pairs = stored(near_pairs(words, levels), "spelling-pairs")
    both = pairs.union(pairs.select("target", "word"))
    counted = both.join(words.select(F.col("word").alias("target"), F.col("n").alias("m")), "target")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "target")).alias("best"))
    big = -F.col("best.less") >= RATIO * F.col("n")
    forms = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                                          F.when(big, F.col("best.target")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))

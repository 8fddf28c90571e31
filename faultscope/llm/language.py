"""Language identification by prediction by partial matching over bytes.

Counting: every byte of a learning text is counted with the ``ORDER`` bytes before it (a text
starts after ``ORDER`` zero bytes). Tasks count in numpy and Spark adds up by (lang, gram);
shorter contexts are sums of the longer ones. All rows with a lang and crc32(id) mod 4 other
than 2 are counted.

Model: a context tree for each lang, frozen. A context of n symbols, u of them different,
gives a symbol s the probability n(s) / (n + u) and the escape u / (n + u); after an escape the
next shorter context leaves out the symbols of the longer one; below the empty context the
symbols left are equally likely. With frozen counts the cost of a gram in a lang is a constant,
so costs of all grams of the longest kind are worked out once, as one row of bits per gram and
a column per lang. A text is scored by looking its grams up and adding rows; a gram that no
lang knows is worked out from the trees on the way.

The model's size is bounded: grams with fewer than ``T`` places are left out, ``T`` being the
smallest power of two that keeps at most ``NODES`` grams, and ``CELLS`` bits (grams x langs).
A gram is never rarer than its longer forms, so each tree stays closed under shortening.
Nothing else is bounded: all learning rows are counted, all texts are scored whole.

Result: the lang of fewest bits (ties: the first in order); the score is its share in the sum
of 2^-bits over langs. Null texts, texts without a letter and every text if no lang could be
learned give ``und`` and score 0.

Edge cases: a null id is read as an empty text for the split; repeated rows count each; long
texts are taken in pieces with their left context; extra columns are ignored; an empty table
gives no rows. Hot langs: counts combine in the task and again map-side. Only the tree, of
bounded size, passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batch_of, by_batch, share, stored, table

ORDER, NODES, CELLS = 4, 1 << 19, 1 << 23
#: Bytes worked on at once in a task, and grams held before they are handed on.
PIECE, HELD = 1 << 20, 1 << 20
UNKNOWN = "und"


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def grams(data: np.ndarray) -> np.ndarray:
    """The gram (its context and the byte, big-endian) that ends at each byte but the first ``ORDER``."""
    n, out = len(data) - ORDER, np.zeros(max(len(data) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | data[k:k + n]
    return out


def pieces(text: str) -> Iterator[np.ndarray]:
    """Byte runs of a text, each after the ``ORDER`` bytes before it."""
    data = np.frombuffer(bytes(ORDER) + text.encode(), np.uint8)
    for at in range(0, max(len(data) - ORDER, 0), PIECE):
        yield data[at:at + PIECE + ORDER]


def count_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all learning rows; partial counts of each task."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        loose: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(lang: str) -> None:
            got, n = np.unique(np.concatenate(loose.pop(lang)), return_counts=True)
            size.pop(lang)
            if lang in counted:
                g = np.concatenate([counted[lang][0], got])
                order = np.argsort(g, kind="stable")
                g, n = g[order], np.concatenate([counted[lang][1], n])[order]
                first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                got, n = g[first], np.add.reduceat(n, first)
            counted[lang] = got, n

        def emit():
            for lang in list(loose):
                settle(lang)
            for lang, (g, n) in counted.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(g)), pa.array(g.astype(np.int64)), pa.array(n)], schema=schema)
            counted.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for data in pieces(text):
                    loose.setdefault(lang, []).append(grams(data))
                    size[lang] = size.get(lang, 0) + len(data)
                    if size[lang] >= 2 * PIECE:
                        settle(lang)
                    elif sum(size.values()) >= 8 * PIECE:
                        settle(max(size, key=size.get))
                    if sum(len(g) for g, _ in counted.values()) >= HELD:
                        yield from emit()
        yield from emit()

    learn = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    part = learn.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The context trees of all langs and the bits of every known gram of full length."""

    def __init__(self, rows: dict[str, np.ndarray], langs: list[str]):
        """``rows``: lang (number), order, gram, n of every kept gram of every order."""
        self.langs = langs
        self.tree = [[self._level(rows, k, m) for m in range(ORDER + 1)] for k in range(len(langs))]
        for levels in self.tree:
            for m in range(1, ORDER + 1):
                self._exclude(levels[m], levels[m - 1], m)
        full = rows["gram"][rows["order"] == ORDER].astype(np.uint64)
        self.known = np.unique(full)
        self.bits = self.cost(self.known).astype(np.float32)

    @staticmethod
    def _level(rows, lang: int, m: int) -> dict[str, np.ndarray]:
        here = (rows["lang"] == lang) & (rows["order"] == m)
        gram, n = rows["gram"][here].astype(np.uint64), rows["n"][here].astype(np.float64)
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        ctx, first = np.unique(gram >> np.uint64(8), return_index=True)
        total = np.add.reduceat(n, first) if len(n) else np.zeros(0)
        kinds = np.diff(np.r_[first, len(gram)]).astype(np.float64)
        return {"gram": gram, "n": n, "ctx": ctx, "first": first, "total": total, "kinds": kinds}

    @staticmethod
    def _exclude(longer, shorter, m: int) -> None:
        """For each context: total and kinds of the next shorter one without the symbols seen here."""
        cut = np.uint64((1 << 8 * m) - 1)
        seen = shorter["n"][np.searchsorted(shorter["gram"], longer["gram"] & cut)]
        seen = np.add.reduceat(seen, longer["first"]) if len(seen) else np.zeros(0)
        up = np.searchsorted(shorter["ctx"], longer["ctx"] & np.uint64((1 << 8 * (m - 1)) - 1))
        longer["up_total"] = shorter["total"][up] - seen
        longer["up_kinds"] = shorter["kinds"][up] - longer["kinds"]

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram of full length after the others: a column per lang."""
        out = np.zeros((len(gram), len(self.langs)))
        for k, levels in enumerate(self.tree):
            bits, open_ = out[:, k], np.ones(len(gram), bool)
            total, kinds = np.full(len(gram), -1.0), np.zeros(len(gram))  # of the level to come; -1: not entered yet
            for m in range(ORDER, -1, -1):
                lv = levels[m]
                if not len(lv["ctx"]):
                    continue
                ctx = (gram >> np.uint64(8)) & np.uint64((1 << 8 * m) - 1)
                at = np.minimum(np.searchsorted(lv["ctx"], ctx), len(lv["ctx"]) - 1)
                here = open_ & (lv["ctx"][at] == ctx)
                whole = gram & np.uint64((1 << 8 * (m + 1)) - 1)
                place = np.minimum(np.searchsorted(lv["gram"], whole), len(lv["gram"]) - 1)
                entered = total >= 0
                t, u = np.where(entered, total, lv["total"][at]), np.where(entered, kinds, lv["kinds"][at])
                hit = here & (lv["gram"][place] == whole)
                bits[hit] += np.log2((t + u)[hit] / lv["n"][place][hit])
                open_ &= ~hit
                on = here & ~hit
                step = on & (u > 0)
                bits[step] += np.log2((t + u)[step] / u[step])
                if m:
                    total[on], kinds[on] = lv["up_total"][at][on], lv["up_kinds"][at][on]
            left = 256 - len(levels[0]["gram"])
            bits[open_] += np.log2(max(left, 1))
        return out

    def rows_of(self, gram: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return self.cost(gram)
        at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        out = self.bits[at]
        new = np.flatnonzero(self.known[at] != gram)
        if len(new):
            kind, back = np.unique(gram[new], return_inverse=True)
            out[new] = self.cost(kind)[back]
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each lang's tree."""
        out = np.zeros((len(texts), len(self.langs)))
        step = max(1, min(PIECE, CELLS // max(len(self.langs), 1)))
        whose, parts, size = [], [], 0

        def add() -> None:
            got = self.rows_of(np.concatenate(parts))
            starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
            np.add.at(out, whose, np.add.reduceat(got, starts, axis=0, dtype=np.float64))

        for k, text in enumerate(texts):
            for data in pieces(text):
                g = grams(data)
                for at in range(0, len(g), step):
                    parts.append(g[at:at + step])
                    whose.append(k)
                    size += len(parts[-1])
                    if size >= step:
                        add()
                        whose, parts, size = [], [], 0
        if parts:
            add()
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", nodes: int = NODES, cells: int = CELLS) -> Trees:
    full = stored(count_grams(docs, id_col, text_col, lang_col), "language-grams")
    masks = F.array(*[F.struct(F.lit(m).alias("order"), F.lit((1 << 8 * (m + 1)) - 1).alias("mask")) for m in range(ORDER + 1)])
    every = (full.select("lang", "n", "gram", F.explode(masks).alias("o")).groupBy("lang", F.col("o.order").alias("order"), F.col("gram").bitwiseAND(F.col("o.mask")).alias("gram"))
             .agg(F.sum("n").alias("n")))
    every = stored(every, "language-tree")
    powers = [1 << j for j in range(62)]
    sizes = every.agg(F.countDistinct("lang").alias("langs"), *[F.count_if(F.col("n") >= p).alias(f"p{j}") for j, p in enumerate(powers)]).first()
    most = min(nodes, cells // max(sizes["langs"], 1))
    least = next((p for j, p in enumerate(powers) if sizes[f"p{j}"] <= most), 1 << 62)
    got = every.where(F.col("n") >= least).select(F.col("lang"), F.col("order").cast("long"), "gram", "n").toArrow()
    coded = got["lang"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names, key=str.encode)
    place = np.array([langs.index(x) for x in names], np.int64)
    return Trees({"lang": place[coded.indices.to_numpy()] if names else np.zeros(0, np.int64), **{c: got[c].to_numpy() for c in ("order", "gram", "n")}}, langs)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", nodes: int = NODES, cells: int = CELLS) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, bits (of the lang chosen)."""
    model = share(docs.sparkSession, learn(docs, id_col, text_col, lang_col, nodes, cells))
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])

    def make():
        trees = model.value

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            spoken = [k for k, ok in enumerate(b.column(2).to_pylist()) if ok and trees.langs]
            pred, score, bits = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            if spoken:
                got = trees.code_lengths([b.column(1)[k].as_py() for k in spoken])
                best = got.argmin(1)
                least = got[np.arange(len(spoken)), best]
                bits[spoken] = least
                score[spoken] = 1 / np.exp2(np.maximum(least[:, None] - got, -1000)).sum(1)
                for k, x in zip(spoken, best, strict=True):
                    pred[k] = trees.langs[x]
            return batch_of(schema, [b.column(0), b.column(3), pred, score, bits])
        return one

    text = F.col(text_col)
    spoken = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), spoken.alias("spoken"), held_out(id_col).alias("held"))
    out = rows.mapInArrow(by_batch(make), "id long, held_out boolean, lang_pred string, score double, bits double")
    return out.withColumnRenamed("id", id_col)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))

"""Operator 7: language identification.

Sparse multinomial logistic regression on TF-IDF of character 1- to 3-grams, fitted by FTRL-proximal
with elastic-net penalties, its probabilities calibrated by a temperature. Letters are lower-cased;
every run of other signs is one blank; grams are hashed in 2**18 places. A gram's weight in a text
is its share of the text's grams times its inverse document frequency, so that a text's scores are
sums over its grams, at any length.

Inverse document frequencies are counted over all rows that the caller marks as usable; weights are fitted on
at most `per_language` texts of each language (a sample by a hash of doc_id), a fifth of which is kept for the
temperature. Of more than `most_languages` languages, those with the most texts are learned. Null texts and
texts without a letter are `und` with score 0. Rows without a language or id are not learned from.
With no usable row every text is `und`. Repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from . import kernels as K

BITS = 18
PLACES = 1 << BITS
#: Languages that are learned at most, those with the most texts; a parameter of train().
MOST_LANGUAGES = 1000
#: Weights that are added up at once in a worker: bounds memory at any length of text and number of languages.
SLICE = 4 << 20


def gram_places(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places of the 1-, 2- and 3-grams that begin at each kept sign, PLACES where a gram would leave
    its row; offsets of rows in them; and whether a row has a letter. `data` is lower-cased."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = lead[offsets]
    letter = K.classes()[points] == K.LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = letter[first]
    sums = np.concatenate(([0], np.cumsum(keep)))
    rows = sums[at]
    letters = np.concatenate(([0], np.cumsum(letter)))[at]
    c = np.where(letter, points, np.uint32(32))[keep]
    shift = np.uint32(32 - BITS)
    a = c * np.uint32(2654435761)
    out = [((a ^ np.uint32(0x5BD1E995)) * np.uint32(0x9E3779B1) >> shift).astype(np.int32)]
    ends = rows[1:][rows[1:] > rows[:-1]]
    for n in (2, 3):
        a = a * np.uint32(0x85EBCA77)
        if len(c) >= n:
            a[: len(c) - n + 1] += c[n - 1 :] * np.uint32(0xC2B2AE3D)
        p = ((a ^ (a >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> shift).astype(np.int32)
        for k in range(1, n):  # the last n-1 signs of a row begin no n-gram
            last = ends - k
            p[last[last >= 0]] = PLACES
        out.append(p)
    return out, rows, np.diff(letters) > 0


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


class Model:
    """Languages, weights times inverse document frequency of the places that have any, bias and temperature."""

    def __init__(self, languages: list[str], places: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        some = np.any(weights != 0, axis=1) if len(places) else np.zeros(0, bool)
        self.languages, self.bias, self.temperature = languages, bias, temperature
        self.rows, self.values = places[some].astype(np.int32), weights[some].astype(np.float32)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place (and the one that stands for none) a row of the values; row 0 is zero."""
        row = np.zeros(PLACES + 1, dtype=np.int32)
        row[self.rows] = np.arange(1, len(self.rows) + 1)
        return row, np.concatenate((np.zeros((1, len(self.languages)), np.float32), self.values.reshape(len(self.rows), len(self.languages))))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, epochs: int = 3, scale: float = 30.0, df: np.ndarray | None = None, docs: int = 0) -> Model:
    """FTRL-proximal over (language, places, counts) of the sampled texts, in the order given.

    df: in how many of `docs` texts each place occurs; if None, it is counted in the sample.
    """
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 1.0)
    code = {k: i for i, k in enumerate(languages)}
    held = [i % 5 == 4 for i in range(len(rows))] if len(rows) >= 10 else [False] * len(rows)
    if df is None:
        df, docs = np.zeros(PLACES), len(rows)
        for _, p, _ in rows:
            df[p] += 1
    # only places of the sample have weights
    used = np.unique(np.concatenate([p for _, p, _ in rows]))
    rows = [(lang, np.searchsorted(used, p), c) for lang, p, c in rows]
    idf = (np.log((1 + docs) / (1 + df)) + 1)[used]
    k, n_used = len(languages), len(used)
    z, n = np.zeros((n_used + 1, k)), np.zeros((n_used + 1, k))  # the last one is the bias

    def weights(p: np.ndarray) -> np.ndarray:
        zp = z[p]
        return np.where(np.abs(zp) <= l1, 0.0, -(zp - np.sign(zp) * l1) / ((beta + np.sqrt(n[p])) / alpha + l2))

    def vector(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(p, n_used), np.append(scale * c / c.sum() * idf[p], 1.0)

    def chances(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    for _ in range(epochs):
        for (lang, p, c), skip in zip(rows, held, strict=True):
            if skip:
                continue
            p, x = vector(p, c)
            w = weights(p)
            g = chances(x @ w)
            g[code[lang]] -= 1
            g = x[:, None] * g[None, :]
            grown = n[p] + g * g
            z[p] += g - (np.sqrt(grown) - np.sqrt(n[p])) / alpha * w
            n[p] = grown
    w = weights(np.arange(n_used + 1))
    judged = [(code[lang], *vector(p, c)) for (lang, p, c), h in zip(rows, held, strict=True) if h]
    temperature = 1.0
    if judged:
        s = np.array([x @ w[p] for _, p, x in judged])
        y = np.array([r[0] for r in judged])

        def loss(t: float) -> float:
            return float(-np.log(np.maximum(chances(s / t)[np.arange(len(y)), y], 1e-12)).mean())

        lo, hi, gold = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
        for _ in range(60):
            a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
            lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
        temperature = float(np.exp((lo + hi) / 2))
    return Model(languages, used, w[:n_used] * (idf * scale)[:, None], w[n_used], temperature)


#: Places whose numbers travel together.
_BLOCK = 1 << 12


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each place occurs, and how many texts there are, over all rows of texts (text)."""

    def count(batches):
        n, slot, docs = np.zeros(PLACES, dtype=np.int64), np.zeros(PLACES, dtype=np.int64), 0
        for batch in base.gathered(batches):
            for lo, hi, data, offsets in K.text_chunks(_lowered(batch.column(0))):
                docs += hi - lo
                grams, at, _ = gram_places(data, offsets)
                for k in range(hi - lo):
                    own = np.concatenate([g[at[k] : at[k + 1]] for g in grams])
                    own = own[own < PLACES]
                    nth = np.arange(len(own))
                    slot[own] = nth  # of equal places the last stands for all
                    n[own[slot[own] == nth]] += 1
        if docs:
            blobs = [n[x : x + _BLOCK].astype("<i8").tobytes() for x in range(0, PLACES, _BLOCK)]
            # block -1 holds the number of texts
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(blobs)), pa.int32()), pa.array([np.array([docs], "<i8").tobytes(), *blobs], pa.binary())], ["block", "n"])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(blob, dtype="<i8")
                sums[block] = sums[block] + x if block in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "n"])

    kind = "block int, n binary"
    out, docs = np.zeros(PLACES, dtype=np.int64), 0
    for r in texts.mapInArrow(count, kind).repartition("block").mapInArrow(added, kind).collect():  # PLACES numbers in all
        x = np.frombuffer(bytes(r["n"]), dtype="<i8")
        if r["block"] < 0:
            docs = int(x[0])
        else:
            out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = x
    return out, docs


def train(docs: DataFrame, usable: Column, per_language: int = 800, most_languages: int = MOST_LANGUAGES) -> Model:
    """The model of docs (doc_id, text, lang) whose `usable` holds and whose lang and text aren't null.

    Document frequencies are those of all such rows. The weights are fitted on at most `per_language` texts of
    each of the `most_languages` languages with the most texts (of equals the first by name); no others are told.
    """
    base.ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_order", F.xxhash64(F.col("doc_id"), F.lit(7)))
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()}
    if not found:
        return fit([])
    df, n_docs = document_frequencies(rows.select("text"))
    # twice the wanted share by the hash, so that the exact cut sorts little
    shares = F.create_map(*(F.lit(x) for lang, n in found.items() for x in (lang, min(1.0, (2 * per_language + 50) / n))))
    share = F.coalesce(shares[F.col("lang")], F.lit(0.0))
    near = rows.where((F.pmod("_order", F.lit(1 << 30)) / float(1 << 30)) < share)

    def run(batches):
        for batch in batches:
            places, counts = [], []
            for _, _, data, offsets in K.text_chunks(_lowered(batch.column(2))):
                grams, at, _ = gram_places(data, offsets)
                for k in range(len(at) - 1):
                    own = np.concatenate([g[at[k] : at[k + 1]] for g in grams])
                    p, c = np.unique(own[own < PLACES], return_counts=True)
                    places.append(p.astype("<i4").tobytes())
                    counts.append(c.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["lang", "order", "places", "counts"])

    cut = near.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id", F.xxhash64("text")))).where(F.col("_nth") <= per_language)
    sample = cut.select("lang", F.col("_order").alias("order"), "text").mapInArrow(run, "lang string, order long, places binary, counts binary").collect()
    sample.sort(key=lambda r: (r["order"], r["lang"], bytes(r["places"])))
    return fit([(r["lang"], np.frombuffer(r["places"], dtype="<i4"), np.frombuffer(r["counts"], dtype="<i4")) for r in sample if r["places"]], df=df, docs=n_docs)


def predict(docs: DataFrame, model: Model, pred: str = "lang_pred", chance: str = "score") -> DataFrame:
    """docs (text and more) with the language and its calibrated probability, in columns of the given names; docs must not have them."""
    base.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most PLACES rows of a weight for each language learned
    if {pred, chance} & set(docs.columns):
        raise ValueError(f"the table has a column {pred} or {chance} already")
    schema = T.StructType([*docs.schema, T.StructField(pred, T.StringType()), T.StructField(chance, T.DoubleType())])
    place = docs.columns.index("text")

    def run(batches):
        m = sent.value
        row, values = m.table()
        names = np.array([*m.languages, "und"], dtype=object)
        step = max(1, SLICE // max(1, len(m.languages)))
        for batch in base.gathered(batches):
            lang = np.full(len(batch), len(m.languages))
            score = np.zeros(len(batch))
            for lo, hi, data, offsets in K.text_chunks(_lowered(batch.column(place))):
                grams, at, letters = gram_places(data, offsets)
                some = np.flatnonzero(letters)
                if not len(some) or not m.languages:
                    continue
                sums = np.zeros((hi - lo, len(m.languages)))
                for x in range(0, int(at[-1]), step):
                    y = min(int(at[-1]), x + step)
                    acc = values[row[grams[0][x:y]]]
                    acc += values[row[grams[1][x:y]]]
                    acc += values[row[grams[2][x:y]]]
                    inside = np.clip(at, x, y)
                    of = np.flatnonzero(inside[1:] > inside[:-1])
                    sums[of] += np.add.reduceat(acc, inside[:-1][of] - x, axis=0, dtype=np.float64)
                sums = sums[some]
                size = np.diff(at)[some]
                total = size + np.maximum(size - 1, 0) + np.maximum(size - 2, 0)
                s = (sums / total[:, None] + m.bias) / m.temperature
                e = np.exp(s - s.max(axis=1, keepdims=True))
                best = s.argmax(axis=1)
                lang[lo + some] = best
                score[lo + some] = 1.0 / e.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[lang], pa.string()), pa.array(score)], [*batch.schema.names, pred, chance])

    return docs.mapInArrow(run, schema)


def held_out(mod: int = 4, rest: int = 2) -> Column:
    """crc32 of doc_id as text leaves `rest`; false for a null id."""
    return F.coalesce(base.crc_mod("doc_id", mod) == rest, F.lit(False))


def identify(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs (doc_id, text, lang); learned from the rows that aren't held out."""
    usable = ~held_out() & F.col("doc_id").isNotNull()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return predict(rows, train(docs, usable, per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, least: float = 0.5, per_language: int = 800) -> DataFrame:
    """The rows of docs whose language is told with at least that probability, with docs' own columns."""
    free = {n.lower() for n in docs.columns}
    pred, chance = (next(c for c in (f"_{x}{i}" for i in range(99)) if c not in free) for x in ("pred", "chance"))
    judged = predict(docs, train(docs, ~held_out() & F.col("doc_id").isNotNull(), per_language), pred, chance)
    return judged.where((F.col(pred) != "und") & (F.col(chance) >= least)).select(*docs.columns)

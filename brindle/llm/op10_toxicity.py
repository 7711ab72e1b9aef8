"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Three disjoint parts of the labelled training rows serve three fits: words and word beginnings that go with
label 1 (the learned lexicon), the trees, and the calibration. Features are rates, so text length tells
little: lexicon densities, lexicon hits near a second person, capitals, punctuation and obfuscated spellings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import store, symbols

#: Insults known beforehand, and second-person words of the corpus's languages.
INSULTS = frozenset("idiot moron stupid dumb scum trash loser pathetic worthless disgusting clown fool imbecile idiota estúpido imbécil idioot dumm dummkopf blöd trottel abschaum stupide crétin abruti basura escoria".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Characters that stand for letters in obfuscated spellings.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", ".": "", "-": "", "_": ""})
WORD = re.compile(r"[^\W_]+")
#: From the beginning of a run of letters only, so that an unbroken text is read once.
OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[0-9@$!*#]+[^\W\d_]+")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
FEATURES = ("insults", "terms", "stems", "weight", "near_you", "capitals", "shouted", "exclaimed", "symbols", "obfuscated", "unmasked", "stretched", "length")
#: Labelled rows that the model is fitted on, about; spread over all of them by a hash.
LABELLED = 20_000
#: Terms and stems kept, at most; and how many toxic rows and standard deviations make one.
LEXICON, LEAST_ROWS, LEAST_Z = 4000, 4, 6.0
STEMS = (4, 5)
NEAR = 5


@dataclass(frozen=True)
class Model:
    """Fitted lexicon, trees and calibration. Without training rows of both labels, only a constant."""

    lexicon: dict[str, float]
    stems: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0


def held_out(doc_id: Column) -> Column:
    """Rows kept from training; a null id is not held out, but has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_features(text: str, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    """Rates of one text, in the order of FEATURES without the last six that bytes alone give."""
    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * 7
    kinds = set(words)
    hits = {w for w in kinds if w in lexicon}
    known = kinds & INSULTS
    rooted = {w for w in kinds if w[:4] in stems or w[:5] in stems}
    odd = [w for w in OBFUSCATED.findall(text)]
    unmasked = sum(1 for w in odd if (x := w.lower().translate(LOOKALIKES)) in INSULTS or x in lexicon)
    insults = terms = roots = near = 0
    weight = max((lexicon[w] for w in hits), default=0.0)
    if rooted:
        weight = max(weight, max(max(stems.get(w[:4], 0.0), stems.get(w[:5], 0.0)) for w in rooted))
    if hits or known or rooted:
        bad = hits | known | rooted
        at = [i for i, w in enumerate(words) if w in bad]
        you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        insults = sum(words[i] in known for i in at)
        terms = sum(words[i] in hits for i in at)
        roots = sum(words[i] in rooted for i in at)
        if len(you):
            place = np.searchsorted(you, at)
            after, before = you[np.minimum(place, len(you) - 1)], you[np.maximum(place - 1, 0)]
            near = int((np.minimum(np.abs(after - at), np.abs(before - at)) <= NEAR).sum())
    return [100 * insults / n, 100 * terms / n, 100 * roots / n, weight, 100 * near / n, 100 * len(odd) / n, 100 * unmasked / n]


def _byte_class(chars: bytes | range) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


UPPER, LETTER = _byte_class(range(65, 91)), _byte_class([*range(65, 91), *range(97, 123), *range(128, 256)])
EXCLAIM, SYMBOL = _byte_class(b"!?"), _byte_class(b"#*$%&|<>@^~")


def _rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """capitals, exclaimed, symbols (per letter or byte) and log length of each text."""
    sums = []
    for table in (UPPER, LETTER, EXCLAIM, SYMBOL):
        total = np.concatenate(([0], np.cumsum(table[data])))
        sums.append(total[offsets[1:]] - total[offsets[:-1]])
    size = np.maximum(np.diff(offsets), 1)
    return np.column_stack((sums[0] / np.maximum(sums[1], 1), 100 * sums[2] / size, 100 * sums[3] / size, np.log1p(size)))


SHOUTED = re.compile(r"\b[A-Z]{3,}\b")


def with_features(rows: DataFrame, lexicon: dict[str, float], stems: dict[str, float]) -> DataFrame:
    """rows (row: a struct with text; other columns) with a column features (array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("row").field("text")
            data, offsets = symbols.text_bytes(column)
            out = np.zeros((batch.num_rows, len(FEATURES)))
            for low, high in symbols.groups_of(offsets, symbols.PIECE):
                rates = _rates(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                out[low:high, [5, 7, 8, 12]] = rates
                for i in range(low, high):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    a = text_features(text, lexicon, stems)
                    words = max(1, text.count(" ") + 1)
                    out[i, [0, 1, 2, 3, 4, 9, 10]] = a
                    out[i, 6] = 100 * len(SHOUTED.findall(text)) / words
                    out[i, 11] = 100 * sum(1 for _ in STRETCHED.finditer(text)) / words
            flat = pa.ListArray.from_arrays(pa.array((np.arange(batch.num_rows + 1) * len(FEATURES)).astype(np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "features"])

    return store.map_arrow(rows, run, rows.withColumn("features", F.array(F.lit(0.0))).schema)


def _beginnings(words: Column, size: int) -> Column:
    """Distinct first letters of the words of that many letters or more."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: F.substring(w, 1, size)))


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings of words (4 or 5 letters) that stand in toxic rows far more often than by chance.

    rows: row.text, label. The weight is the smoothed log-odds; the strongest LEXICON of either kind stay.
    """
    words = rows.select("label", F.array_distinct(F.split(F.lower("row.text"), r"[^\p{L}\p{N}]+")).alias("words"))
    whole = words.select("label", F.explode("words").alias("term"), F.lit(0).alias("kind"))
    starts = [words.select("label", F.explode(_beginnings(F.col("words"), k)).alias("term"), F.lit(k).alias("kind")) for k in STEMS]
    for x in starts:
        whole = whole.unionByName(x)
    base = rows.agg(F.avg("label")).first()[0] or 0.0
    if not 0 < base < 1:
        return {}, {}
    n, k = F.col("n"), F.col("k")
    terms = whole.where("length(term) > 1").groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    terms = terms.where((k >= LEAST_ROWS) & ((k - n * base) / F.sqrt(n * base * (1 - base)) >= LEAST_Z) & (k >= 0.5 * n))
    terms = terms.withColumn("weight", F.log((k + 0.5) / (n - k + 0.5)) - math.log(base / (1 - base)))
    best = [terms.where("kind = 0"), terms.where("kind > 0")]
    return tuple({r["term"]: r["weight"] for r in x.orderBy(F.desc("weight"), F.desc("n"), "term").limit(LEXICON).collect()} for x in best)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, seed: int = 7) -> Model:
    """Fit on the rows of docs that are labelled and not held out; about `labelled` of them, chosen by a hash of the id.

    Null labels are no labels; of several labels of an id the largest counts. Without rows of both labels the
    model gives every text the share of label 1 (0 if there are no rows).
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("double").alias("label"))
    marks = marks.where(~held_out(F.col("_id")))
    share = min(1.0, labelled / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    marks = marks.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(10)))
    rows = docs.select(F.struct("text").alias("row"), F.col("doc_id").alias("_id")).join(F.broadcast(marks), "_id")  # marks: about `labelled` rows
    rows = store.table(rows, "labelled")
    counts = {bool(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model({}, {}, None, None, counts.get(True, 0) / total if total else 0.0)
    lexicon, stems = learn_lexicon(rows.where("part < 5"))
    ready = store.table(with_features(rows.select("row", "label", "part"), lexicon, stems).select("label", "part", array_to_vector("features").alias("features")), "features")
    fits = ready.where("part between 5 and 7")
    if fits.select("label").distinct().count() < 2:
        fits = ready
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=seed, minInstancesPerNode=2, cacheNodeIds=False).fit(fits)
    held = ready.where("part > 7")
    if held.select("label").distinct().count() < 2:
        held = ready
    held = trees.transform(held).select(vector_to_array("probability")[1].alias("p"), "label")
    return Model(lexicon, stems, trees, IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(held))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns row (all of docs, as a struct) and score. Null and empty texts are scored as texts without words."""
    rows = docs.select(F.struct("*").alias("row"))
    if model.trees is None:
        return rows.withColumn("score", F.lit(float(model.constant)))
    ready = with_features(rows, model.lexicon, model.stems).withColumn("features", array_to_vector("features"))
    marked = model.trees.transform(ready).withColumn("p", vector_to_array("probability")[1])
    return model.calibration.transform(marked).select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    docs = docs.select("doc_id", "text")
    rows = score(docs, fit(docs, labels))
    return rows.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold."""
    return score(docs, fit(docs, labels)).where(F.col("score") < threshold).select("row.*")

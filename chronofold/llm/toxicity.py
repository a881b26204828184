"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates over a whole text: words of an insult lexicon, such words near a second person,
capitals, punctuation and obfuscated words. The lexicon is a given list and the words and word
beginnings that training rows show to be tied to toxic texts, in any language. Words are compared
without case and punctuation, and once more with digits and signs read as the letters they stand
for or as a masked letter.

At most ``sample`` labelled rows are learnt from, those with the smallest hash of their id. A
half of them gives the lexicon, a quarter fits the trees, a quarter the calibration. Without rows of both labels there is nothing to
learn: every score is the share of toxic training rows (0 without any).

A text without words has features of zero and is scored like any other; null text counts as empty.
Rows are scored one by one, so repeated rows get equal scores. Labels that are null are not used;
several labels of one id count as the largest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.flat import SMALL_PIECE_BYTES, byte_hasher, byte_hashes, pieces, words
from chronofold.llm.tables import written

SAMPLE = 20_000
#: Learnt lexicon entries: at most so many, in so many toxic training rows at least.
LEARNT_ENTRIES, LEARNT_ROWS = 5000, 4
#: Letters of a word's beginning that can be an entry of the lexicon.
STEM_LETTERS = (4, 5, 6)
TREES, DEPTH, STEP = 20, 3, 0.3
NEAR = 5

INSULTS = (
    "asshole bastard bitch clown coward crap creep cretin degenerate dickhead disgusting dumb "
    "dumbass filth filthy fool freak garbage idiot idiotic idiots imbecile jerk liar loser losers "
    "lowlife maggot moron morons nasty parasite pathetic pig pigs psycho rat retard retarded scum "
    "scumbag shit shut slut stupid stupidity trash twat ugly useless vermin weirdo whore worthless "
    "wretch abschaum arsch arschloch blöd dreck dumm dummkopf ekelhaft erbärmlich idioten nutzlos "
    "schlampe schwein trottel verlierer versager wertlos abruti clochard con connard crétin débile "
    "dégoûtant imbécile inutile merde minable nul nulle ordure pathétique perdant salaud stupide "
    "asco asqueroso basura cabrón cerdo escoria estúpido idiota imbécil inútil mierda patético "
    "payaso perdedor tonto"
)
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta "
    "tes vous votre vos tú ti tus usted ustedes vosotros vuestro"
)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?\"'()-"))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>@^~_=+"))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STANDS_FOR = _FOLD.copy()
for _sign, _letter in zip(b"013457@$!|+", b"oieastasiit", strict=True):
    _STANDS_FOR[_sign] = _letter
_KEEP_MASKED = _LETTER.copy()
_KEEP_MASKED[list(b"*013457@$!|+")] = True

FEATURES = (
    "lexicon_rate lexicon_any learnt_rate learnt_any stem_rate stem_any obfuscated_lexicon_rate near_second_person second_person_rate "
    "capital_rate capital_word_rate exclamation_rate punctuation_rate symbol_rate digit_rate "
    "obfuscation_rate word_length log_words"
).split()


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _hashes(entries: Iterator[str] | list[str]) -> np.ndarray:
    raw = [e.encode() for e in entries]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return np.unique(byte_hashes(data, ends - size, ends))


def _masked(word: str) -> set[str]:
    """The word with one inner letter, or all its inner vowels, as an asterisk."""
    out = {word[:i] + "*" + word[i + 1 :] for i in range(1, len(word) - 1)}
    inner = "".join("*" if c in "aeiou" else c for c in word[1:-1])
    return {*out, word[:1] + inner + word[-1:]} if len(word) > 3 else set()


def _squeezed(data: np.ndarray, keep: np.ndarray, start, end):
    """The kept bytes, and where the spans lie among them."""
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[start], before[end]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _stems(letters: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each k of STEM_LETTERS: where the first k letters end, and which words are longer."""
    at = np.append(np.flatnonzero((letters & 0xC0) != 0x80), [len(letters)])
    char = np.searchsorted(at[:-1], start)
    for k in STEM_LETTERS:
        stop = at[np.minimum(char + k, len(at) - 1)]
        yield stop, stop < end


def _features(lexicon: tuple[str, ...]):
    given = INSULTS.split()
    plain = _hashes(given)
    masked = _hashes([*given, *sorted({m for w in given for m in _masked(w)})])
    learnt = _hashes([w for w in lexicon if not w.startswith("^")])
    stems = _hashes([w[1:] for w in lexicon if w.startswith("^")])
    person = _hashes(SECOND_PERSON.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text", SMALL_PIECE_BYTES):
            found = words(data, offsets)
            start, end, first = found.start, found.end, found.first
            folded = _FOLD[data]
            latin = np.flatnonzero(data[:-1] == 0xC3) + 1
            latin = latin[(data[latin] <= 0x9E) & (data[latin] != 0x97)]
            folded[latin] += 0x20
            letters, a, b = _squeezed(folded, _LETTER[data], start, end)
            hashed = byte_hasher(letters)
            bare = hashed(a, b)
            lexical = _among(bare, plain) & (b > a)
            second = _among(bare, person) & (b > a)
            tied = _among(bare, learnt) & (b > a)
            begun = np.zeros(len(start), dtype=bool)
            for stop, longer in _stems(letters, a, b):
                begun |= longer & _among(hashed(a, np.where(longer, stop, b)), stems)
            del hashed, letters, folded  # the sums take sixteen bytes a letter
            shown, c, d = _squeezed(_STANDS_FOR[data], _KEEP_MASKED[data], start, end)
            hidden = ~lexical & (d - c > 2) & _among(byte_hashes(shown, c, d), masked)
            hit = lexical | hidden | tied | begun
            # letters with a digit or sign between them
            outer = np.concatenate([[0], np.cumsum(_LETTER[data])])
            inner_sign = np.flatnonzero(
                ((_SYMBOL | _DIGIT)[data[1:-1]]) & _LETTER[data[:-2]] & _LETTER[data[2:]]
            ) + 1
            broken = np.zeros(len(start), dtype=bool)
            if len(start) and len(inner_sign):
                broken[np.searchsorted(start, inner_sign, side="right") - 1] = True
            capital = np.concatenate([[0], np.cumsum(_UPPER[data])])
            shouted = (capital[end] - capital[start] == outer[end] - outer[start]) & (b - a > 2)

            owner = found.owner()
            seconds = np.concatenate([[0], np.cumsum(second)])
            at = np.flatnonzero(hit)
            low = np.maximum(at - NEAR, first[owner[at]])
            high = np.minimum(at + NEAR + 1, first[owner[at] + 1])
            near = np.zeros(len(start), dtype=np.int64)
            near[at] = seconds[high] > seconds[low]

            def per_text(flag: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
                return (sums[first[1:]] - sums[first[:-1]]).astype(float)

            def per_byte(flag: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
                return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

            n = np.maximum(found.counts, 1).astype(float)
            size = np.maximum(np.diff(offsets), 1).astype(float)
            alphabetic = np.maximum(per_byte(_LETTER[data]), 1.0)
            columns = []
            for flag in (lexical | hidden, tied, begun):
                count = per_text(flag)
                columns += [count / n, np.minimum(count, 5.0)]
            columns += [
                per_text(hidden) / n,
                per_text(near) / n,
                per_text(second) / n,
                per_byte(_UPPER[data]) / alphabetic,
                per_text(shouted) / n,
                per_byte(data == 0x21) / size,
                per_byte(_PUNCTUATION[data]) / size,
                per_byte(_SYMBOL[data]) / size,
                per_byte(_DIGIT[data]) / size,
                per_text(broken) / n,
                per_byte(_LETTER[data]) / n,
                np.log1p(found.counts.astype(float)),
            ]
            flat = np.column_stack(columns)
            cuts = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.reshape(-1))),
                ],
                ["row", "features"],
            )

    return run


def features(docs: DataFrame, lexicon: tuple[str, ...]) -> DataFrame:
    """``row``, the input row as a struct, and its ``features``."""
    base = docs.select(F.struct("*").alias("row"), "text")
    schema = T.StructType(
        [base.schema["row"], T.StructField("features", T.ArrayType(T.DoubleType()))]
    )
    return base.mapInArrow(_features(lexicon), schema)


@dataclass
class Model:
    lexicon: tuple[str, ...]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base_rate: float

    def score(self, docs: DataFrame) -> DataFrame:
        """``row``, the input row as a struct, and its ``score``."""
        if self.trees is None:
            return docs.select(F.struct("*").alias("row"), F.lit(self.base_rate).alias("score"))
        return self._calibrated(features(docs, self.lexicon)).select("row", "score")

    def raw(self, found: DataFrame) -> DataFrame:
        vectors = found.withColumn("features", array_to_vector("features"))
        scored = self.trees.transform(vectors)
        return scored.withColumn("raw", vector_to_array("probability")[1])

    def _calibrated(self, found: DataFrame) -> DataFrame:
        scored = self.raw(found)
        score = F.col("raw")
        if self.calibration is not None:
            scored = self.calibration.transform(scored)
            score = F.col("calibrated")
        return scored.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def _learnt_lexicon(rows: DataFrame) -> list[str]:
    """Words and word beginnings (marked by ^) far more usual in toxic texts: smoothed odds of 20
    to 1 and more, those in most texts first."""
    words_ = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))

    def begins(k: int) -> Column:
        long = F.filter("words", lambda w: F.length(w) > k)
        return F.array_distinct(F.transform(long, lambda w: F.concat(F.lit("^"), F.substring(w, 1, k))))

    entries = F.concat("words", *[begins(k) for k in STEM_LETTERS])
    counts = (
        rows.withColumn("words", words_)
        .select("toxic", F.explode(entries).alias("entry"))
        .groupBy("entry")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"))
        .where(F.col("t") >= LEARNT_ROWS)
    )
    size = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f")).first()
    if not size["t"] or not size["f"]:
        return []
    odds = ((F.col("t") + 0.5) / (size["t"] + 1)) / ((F.col("f") + 0.5) / (size["f"] + 1))
    best = counts.where(odds >= 20).orderBy(F.desc("t"), "entry").limit(LEARNT_ENTRIES)
    return [r["entry"] for r in best.select("entry").collect()]  # at most LEARNT_ENTRIES


def fit(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Callable[[Column], Column] | None = None,
    sample: int = SAMPLE,
) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")
    )
    if held_out is not None:
        known = known.where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(order, "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.join(F.broadcast(known), "doc_id"), "training")  # ``sample`` ids at most
    part = F.pmod(order, F.lit(4))  # 0: calibration, 1: trees, 2 and 3: lexicon
    lexicon = tuple(_learnt_lexicon(rows.where(part >= 2)))
    learnt = rows.where(part < 2).withColumn("part", part).select("toxic", "part", "text")
    found = features(learnt, lexicon).select("row.toxic", "row.part", "features")
    found = written(found, "features")
    counts = {
        (r["fits"], r["toxic"]): r["n"]
        for r in found.groupBy((F.col("part") > 0).alias("fits"), "toxic")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    rate = float(rows.agg(F.avg("toxic")).first()[0] or 0.0)
    if not (counts.get((True, 0)) and counts.get((True, 1))):
        return Model(lexicon, None, None, rate)
    training = found.where("part > 0").withColumn("features", array_to_vector("features"))
    training = training.withColumn("toxic", F.col("toxic").cast("double"))
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="toxic",
        maxIter=TREES,
        maxDepth=DEPTH,
        stepSize=STEP,
        minInstancesPerNode=2,
        seed=7,
    ).fit(training.coalesce(4))
    model = Model(lexicon, trees, None, rate)
    if counts.get((False, 0)) and counts.get((False, 1)):
        scored = model.raw(found.where("part = 0")).withColumn("y", F.col("toxic").cast("double"))
        model.calibration = IsotonicRegression(
            featuresCol="raw", labelCol="y", predictionCol="calibrated"
        ).fit(scored.select("raw", "y"))
    return model

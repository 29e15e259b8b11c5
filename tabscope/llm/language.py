"""Language identification in two levels: linear machines choose the family, then one-versus-one machines
separate the languages of that family.

Features are hashed byte n-grams and words of the whole text. The machines are fitted on the driver from a
bounded sample of labelled rows, drawn by a hash of the id; prediction runs in Arrow batches.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabscope.llm import linear
from tabscope.llm.rows import map_rows
from tabscope.llm.textbytes import LOWER, packed, profile, unpacked

#: Bound of the training sample: rows a language, and rows in all.
SAMPLE_PER_LANGUAGE, SAMPLE = 500, 2500
GRAMS, WORD_GRAMS, BITS = (2, 3), (1,), 11
UNKNOWN = "und"

#: Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv", "celtic": "ga gd cy br", "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tk tt ug", "indic": "hi ur bn pa gu mr ne si as or sa",
    "dravidian": "ta te kn ml", "semitic": "ar he mt am", "iranian": "fa ps ku tg",
    "sinitic": "zh yue", "japonic": "ja", "koreanic": "ko",
    "austronesian": "id ms tl jv su mg mi", "bantu": "sw zu xh rw sn",
}


def family_of(language: str) -> str:
    """The family of a code such as ``pt`` or ``pt-BR``; the code itself if it is in no family."""
    code = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"only {language}")


def held_out(doc_id: Column | str, parts: int = 5) -> Column:
    """Whether a document's id puts it into the part that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0 if isinstance(doc_id, str)
                      else F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def features(text: bytes) -> np.ndarray:
    return profile(text.translate(LOWER), GRAMS, WORD_GRAMS, BITS)


WIDTH = 2 << BITS


class Machines:
    """One-versus-one linear machines between the classes of one level."""

    def __init__(self, classes: list[str], rows: np.ndarray, labels: np.ndarray) -> None:
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        self.weights, self.slopes, self.offsets = [], [], []
        for a, b in self.pairs:
            chosen = (labels == classes[a]) | (labels == classes[b])
            signs = np.where(labels[chosen] == classes[a], 1.0, -1.0).astype(np.float32)
            weights, slope, offset = linear.fit_calibrated(rows[chosen], signs, "hinge")
            self.weights.append(weights)
            self.slopes.append(slope)
            self.offsets.append(offset)
        self.matrix = np.array(self.weights, np.float32) if self.pairs else None

    def decide(self, vector: np.ndarray) -> tuple[str, float]:
        """The class with the most won pairs (ties: the larger sum of probabilities, then the first), and its
        mean probability in its pairs.
        """
        if self.matrix is None:
            return self.classes[0], 1.0
        values = self.matrix[:, :-1] @ vector + self.matrix[:, -1]
        chances = linear.sigmoid(np.array(self.slopes) * values + np.array(self.offsets))
        wins, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (a, b), value, p in zip(self.pairs, values, chances, strict=True):
            wins[a if value >= 0 else b] += 1
            sums[a] += p
            sums[b] += 1 - p
        best = max(range(len(self.classes)), key=lambda i: (wins[i], sums[i], -i))
        return self.classes[best], float(sums[best] / (len(self.classes) - 1))


class Model:
    """Family machines, and the machines inside each family."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        names = sorted(set(labels))
        families = np.array([family_of(x) for x in labels], dtype=object)
        self.families = Machines(sorted(set(families)), rows, families)
        self.inside = {}
        for family in self.families.classes:
            own = families == family
            self.inside[family] = Machines([x for x in names if family_of(x) == family], rows[own], labels[own])

    def judge(self, text: bytes) -> tuple[str, float, float]:
        """The language, and the probabilities of its family and of it inside the family."""
        vector = features(text)
        family, p = self.families.decide(vector)
        language, q = self.inside[family].decide(vector)
        return language, p, q

    def predict(self, text: bytes, by_family: bool = False) -> tuple[str, float]:
        language, p, q = self.judge(text)
        return language, min(1.0, max(0.0, p if by_family else p * q))


def training_sample(docs: DataFrame, per_language: int, total: int) -> DataFrame:
    """At most ``per_language`` labelled rows of each language and ``total`` in all, by a hash of id and text.

    A first pass counts the languages; a second keeps about twice what is wanted by the hash, and the exact
    bound is applied to that remainder.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"))
    counts = counts.orderBy(F.desc("rows"), "lang").limit(total)  # a language needs a row at least
    kinds = counts.count()
    wanted = max(1, min(per_language, total // max(1, kinds)))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    near = (
        usable.select("doc_id", "text", "lang").join(F.broadcast(counts), "lang")
        .withColumn("draw", draw)
        .where(F.col("draw") < F.ceil(F.lit(1 << 40) * (2.0 * wanted + 20) / F.col("rows")))
    )
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).select("lang", "text")


def train(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE
) -> Model | None:
    """Fit on rows with a text, a language and an id that is not held out; None if there are none."""
    labelled = docs.where(~held_out("doc_id"))
    sample = training_sample(labelled, per_language, total)
    vectors = map_rows(sample, ["lang", "text"], "lang string, vector binary",
                       lambda: lambda lang, text: (lang, packed(features(text.encode()))))
    found = sorted(vectors.collect(), key=lambda r: (r.vector, r.lang))  # at most ``total`` rows
    if not found:
        return None
    return Model(unpacked([r.vector for r in found], WIDTH), np.array([r.lang for r in found], dtype=object))


def identify(
    docs: DataFrame, model: Model | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"),
    by_family: bool = False,
) -> DataFrame:
    """The language and its score (0 to 1), named ``names``, beside ``keep`` columns of documents (default: ``doc_id``).

    A null text, or one without a letter, is ``und`` with score 0, and so is all without a model. Each row
    is judged alone: no shuffle, ties and repeated rows come out as they come in. With ``by_family``, the score is that of
    the family alone.
    """
    keep = keep if keep is not None else ["doc_id"]
    fields = [docs.schema[k] for k in keep]
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        letter, learned = regex.compile(r"\p{L}"), shared.value

        def work(text: str | None, *kept: object) -> tuple:
            if learned is None or not text or not letter.search(text):
                return (*kept, UNKNOWN, 0.0)
            return (*kept, *learned.predict(text.encode(), by_family))

        return work

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return map_rows(docs, ["text", *(F.col(f"`{k}`") for k in keep)], ddl, start)

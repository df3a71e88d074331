"""Language identification by multilingual mixture inference.

A model holds, for each language, the probability of hashed byte 4-grams of lower-cased text. A document is a mixture
of languages: expectation-maximisation estimates the proportions from the likelihoods of its n-grams. Starting with
the language of the largest proportion, further ones join the set while the likelihood, penalised per language, still
rises; the prediction is the language with the largest proportion in the chosen set.

The model is fitted on a bounded sample: of each language the `per_language` training documents with the smallest hash
of doc_id. It has one row of N_BUCKETS numbers per language code, and only those sums reach the driver.

Input of predict: doc_id, text. Null texts and texts without a letter are `und` with score 0, as is all when nothing
could be learned. Rows are independent; repeated rows and null ids come back as they are. Output: doc_id, lang_pred,
score (the proportion), langs (the chosen set, largest first), explained (false for a text that the chosen set explains
worse than a source which knows no language, such as one in a language that was not learned; and for `und`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, id_and_text, over_batches

N_BUCKETS = 1 << 15
PER_LANGUAGE = 2000
GRAM = 4
EM_ROUNDS = 10
UNDETERMINED = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


# Bytes of ASCII that stand in no word: of digits and signs nobody can say which language they are in
_NO_WORD = np.array([b < 128 and b != 32 and not chr(b).isalpha() for b in range(256)])


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(b"  " + text.lower().encode("utf-8", "replace") + b"  ", dtype=np.uint8)


def _buckets(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.uint32)
    x = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    return (x * np.uint32(2654435761)) >> np.uint32(32 - 15)


def grams(text: str) -> np.ndarray:
    """Bucket of each byte 4-gram; two spaces on either side."""
    return _buckets(_raw(text))


def _of_words(raw: np.ndarray) -> np.ndarray:
    """For each 4-gram, whether it is of letters and blanks alone."""
    no = _NO_WORD[raw]
    return ~(no[:-3] | no[1:-2] | no[2:-1] | no[3:])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages x buckets. Add-half smoothing; each bucket is scaled by its largest probability, which
        changes all likelihoods of a text alike."""
        self.langs = langs
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * N_BUCKETS)
        self.p = np.ascontiguousarray((p / p.max(axis=0)).T) if langs else np.zeros((N_BUCKETS, 0))
        # what the scale has taken, against a source that knows no language: all buckets alike
        self.over_even = np.log(p.max(axis=0) * N_BUCKETS) if langs else np.zeros(N_BUCKETS)

    @staticmethod
    def mix(p: np.ndarray, c: np.ndarray | float, total: float) -> tuple[np.ndarray, float]:
        share = np.full(p.shape[1], 1.0 / p.shape[1])
        for _ in range(EM_ROUNDS if p.shape[1] > 1 else 0):
            share = share * (p.T @ (c / (p @ share))) / total
        return share, float((c * np.log(p @ share)).sum())

    def explains(self, g: np.ndarray, chosen: np.ndarray, share: np.ndarray) -> bool:
        """Whether the chosen languages make these n-grams likelier than evenly drawn ones are; a doubt as large as the
        penalty of a language is in the text's favour."""
        over = float((np.log(self.p[g][:, chosen] @ share) + self.over_even[g]).sum())
        return over >= -GRAM * (2 + 0.5 * math.log(len(g) + 1))

    def predict(self, text: str | None) -> tuple[str, float, str, bool]:
        """Prediction, its proportion, the chosen set, and whether that explains the words of the text."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, "", False
        raw = _raw(text)
        g = _buckets(raw)
        of_words = g[_of_words(raw)]
        total = float(len(g))
        c: np.ndarray | float = 1.0
        if len(g) > N_BUCKETS:
            n = np.bincount(g, minlength=N_BUCKETS)
            g = np.flatnonzero(n)
            c = n[g].astype(float)
        p = self.p[g]
        share, _ = self.mix(p, c, total)
        order = np.argsort(-share, kind="stable")
        # every character is in GRAM n-grams, so their joint likelihood counts it as often
        penalty = GRAM * (2 + 0.5 * math.log(total + 1))
        chosen, best = 1, self.mix(p[:, order[:1]], c, total)
        while chosen < len(order):
            more = self.mix(p[:, order[:chosen + 1]], c, total)
            if more[1] - best[1] <= penalty:
                break
            chosen, best = chosen + 1, more
        ranked = sorted(zip(-best[0], (self.langs[i] for i in order[:chosen])))
        return ranked[0][1], float(min(1.0, -ranked[0][0])), ",".join(x for _, x in ranked), self.explains(of_words, order[:chosen], best[0])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs: doc_id, text, lang. Held-out documents and those without id or language are not used."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # of a large language only the smallest hashes go to the window: about four times as many as it takes
    n = F.broadcast(d.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")))  # a row per language code
    small = (F.xxhash64("doc_id") / F.lit(2.0 ** 64) + 0.5) * F.col("n") <= 4 * per_language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = d.select("doc_id", "lang").join(n, F.col("lang") == F.col("of")).filter(small).withColumn("k", rank).filter(F.col("k") <= per_language).select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("sample_lang")).distinct()
    # bounded: per_language rows for each language code
    texts = d.join(F.broadcast(sample), (F.col("doc_id") == F.col("sample_id")) & (F.col("lang") == F.col("sample_lang"))).select("lang", "text")

    def make():
        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    n = np.bincount(grams(text), minlength=N_BUCKETS)
                    sums[lang] = sums[lang] + n if lang in sums else n
            at = {k: np.flatnonzero(v) for k, v in sums.items()}
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k in sums for _ in range(len(at[k]))], pa.string()),
                 pa.array(np.concatenate([at[k] for k in sums] or [np.zeros(0)]).astype(np.int32)),
                 pa.array(np.concatenate([sums[k][at[k]] for k in sums] or [np.zeros(0)]).astype(np.int64))],
                ["lang", "bucket", "n"])

        return apply

    counted = over_batches(texts, make, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), N_BUCKETS))
    counts[[langs.index(x) for x in got["lang"]], got["bucket"].to_numpy(int)] = got["n"].to_numpy(float)
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """Adds lang_pred, score, langs and explained to the carried columns (doc_id, if none are named) by docs.text."""
    keep = list(carried) or ["doc_id"]
    added = {"lang_pred": pa.string(), "score": pa.float64(), "langs": pa.string(), "explained": pa.bool_()}
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        hold("langid")
        own = held.value

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [own.predict(t) for t in b.column(len(keep)).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], *(pa.array([g[i] for g in got], kind) for i, kind in enumerate(added.values()))],
                [*keep, *added])

        return apply

    rows = docs.select(*keep, "text")
    schema = rows.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "langs": F.lit(""), "explained": F.lit(False)}).schema
    return over_batches(rows, make, schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fits on docs and predicts for each row."""
    return predict(id_and_text(docs), fit(docs, per_language)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")

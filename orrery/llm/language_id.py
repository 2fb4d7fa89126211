"""Language identification with error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
#: Loss differences are scaled by this before they are turned into a score.
SHARPNESS = 6.0
#: Predictions that score less are flagged as ambiguous.
AMBIGUOUS = 0.6
_SLICE = 1 << 18


@dataclass(frozen=True)
class Model:
    """languages (k), codewords (k x bits, of -1 and 1), weights (features x bits) of the binary
    classifiers, scale (bits) of their usual margin and reliability (k x bits) of each bit for each
    language. Its size depends on the number of languages and features alone."""

    languages: list[str]
    codewords: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    reliability: np.ndarray


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and 1: all distinct splits for up to 7 languages, else random columns."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        splits = [[1 if c == 0 or (s >> (c - 1)) & 1 else -1 for c in range(k)] for s in range(2 ** (k - 1) - 1)]
        return np.array(splits, dtype=float).T
    rng, bits = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(k)))
    tries = [rng.choice([-1.0, 1.0], (k, bits)) for _ in range(64)]
    return max(tries, key=lambda c: np.min([np.sum(c[i] != c[j]) for i in range(k) for j in range(i)]))


def ngram_counts(texts: list[bytes], features: int) -> np.ndarray:
    """(texts x features) counts of hashed byte 2-grams, 3-grams and 4-grams of the whole texts.

    Texts are lower-cased by the caller and stand between blanks; other characters than letters
    count as blanks, and a gram's second byte is none, so that digits and punctuation say nothing.
    """
    out = np.zeros((len(texts), features), dtype=np.float32)
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= _SLICE):
            size += len(texts[upto])
            upto += 1
        _add_counts(texts[at:upto], out[at:upto])
        at = upto
    return out


def _add_counts(texts: list[bytes], out: np.ndarray) -> None:
    features = out.shape[1]
    gap = b" " * 3
    joined = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + len(gap) for t in texts])
    for s in range(0, len(owner), _SLICE):  # a very long text comes in overlapping slices
        part, of = joined[s : s + _SLICE + 3], owner[s : s + _SLICE]
        letter = (part >= 128) | ((part >= 97) & (part <= 122))
        b = np.where(letter, part, 32).astype(np.uint32)
        n = len(of)
        b = np.concatenate([b, np.full(max(0, n + 3 - len(b)), 32, dtype=np.uint32)])
        b0, b1, b2, b3 = (b[i : i + n] for i in range(4))
        two = b0 * np.uint32(0x9E3779B1) + b1 * np.uint32(0x85EBCA77)
        three = two + b2 * np.uint32(0xC2B2AE3D)
        four = three + b3 * np.uint32(0x27D4EB2F)
        base = of * features
        inside = b1 != 32  # a blank followed by a blank is not a gram
        for h in (two, three, four):
            h = h ^ (h >> np.uint32(15))
            h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (features.bit_length() - 1))
            flat = np.bincount((base + h)[inside], minlength=out.size)
            out += flat.reshape(out.shape)


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def _chunks(batch: pa.RecordBatch, features: int, budget: int = 1 << 23) -> Iterator[tuple[int, list[bytes]]]:
    step = max(1, budget // (features * 4))
    for at in range(0, batch.num_rows, step):
        yield at, [t.as_py() for t in batch.column(1).slice(at, step)]


def train(labelled: DataFrame, text_col: str, lang_col: str, features: int = 1 << 13) -> Model:
    """Fit the classifiers on every row of ``labelled`` that has a text and a language.

    The sums behind the weights, counts of n-grams by language, are added up in Spark; the driver
    gets ``features`` rows a language. Each binary classifier is a naive Bayes log ratio of the
    n-grams of the languages on either side of its bit.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), _lowered(F.col(text_col)).alias("text"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for at, texts in _chunks(batch, features):
                counts = ngram_counts(texts, features)
                for lang in set(langs[at : at + len(texts)]):
                    own = counts[langs[at : at + len(texts)] == lang].sum(axis=0, dtype=np.float64)
                    total[lang] = total.get(lang, 0) + own
        for lang, sums in total.items():
            index = np.nonzero(sums)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(index), pa.string()), pa.array(index.astype(np.int32)), pa.array(sums[index].astype(np.int64))],
                names=["lang", "feature", "n"],
            )

    counts = rows.mapInArrow(summed, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    return _fit(counts.toArrow().to_pandas(), features)


def _fit(counts: pd.DataFrame, features: int) -> Model:
    languages = sorted(counts["lang"].unique())
    table = np.zeros((len(languages), features))
    table[[languages.index(x) for x in counts["lang"]], counts["feature"]] = counts["n"]
    share = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((features, code.shape[1]))
    for bit in range(code.shape[1]):
        ones, others = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(ones) and len(others):
            weights[:, bit] = np.log(ones.mean(axis=0)) - np.log(others.mean(axis=0))
    usual = (share @ weights) * code
    scale = np.maximum(np.abs(usual).mean(axis=0), 1e-9) if len(languages) else np.ones(code.shape[1])
    reliability = np.maximum(usual / scale, 0.05)
    reliability /= reliability.sum(axis=1, keepdims=True)
    return Model(languages, code, weights.astype(np.float32), scale, reliability)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, score) of rows of mean margins: the codeword of least weighted logistic
    loss, ties to the first language; score is its share of exp(-loss) among all."""
    z = np.clip(margins / model.scale, -4, 4)
    agreed = z[:, None, :] * model.codewords[None]
    loss = (np.log1p(np.exp(-2 * agreed)) * model.reliability[None]).sum(axis=2)
    best = loss.argmin(axis=1)
    likely = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    return best, 1 / likely.sum(axis=1)


def classify(text: Column, model: Model) -> Column:
    """A struct (lang_pred, score, ambiguous), from the whole text alone.

    A null text and one without any letter give ``und`` with score 1; so does every text if the
    model has no language."""
    names = np.array(model.languages, dtype=object)
    features = model.weights.shape[0]
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    @F.pandas_udf(kind)
    def scored(lowered: pd.Series, lettered: pd.Series) -> pd.DataFrame:
        pred = np.full(len(lowered), UNDETERMINED, dtype=object)
        score = np.ones(len(lowered))
        step = max(1, (1 << 23) // (features * 4))
        for at in range(0, len(lowered), step):
            texts = lowered.iloc[at : at + step].tolist()
            known = lettered.iloc[at : at + step].to_numpy(dtype=bool) & (len(names) > 0)
            if known.any():
                counts = ngram_counts(texts, features)
                margins = counts @ model.weights / np.maximum(counts.sum(axis=1, keepdims=True), 1)
                best, sure = decode(model, margins)
                pred[at : at + step][known] = names[best][known]
                score[at : at + step][known] = sure[known]
        return pd.DataFrame({"lang_pred": pred, "score": score, "ambiguous": score < AMBIGUOUS})

    return scored(_lowered(text), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row. Ids are passed on, nulls and repeats too."""
    found = classify(F.col(text_col), model).alias("_language")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found).select("doc_id", "_language.*")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language can't be told, judged where they are read."""
    return docs.where(classify(F.col(text_col), model)["lang_pred"] != UNDETERMINED)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows of ``documents`` outside fold 2 and predict every row (a null id is in no
    fold: predicted, not learned from). Adds held_out to what predict() returns."""
    model = train(docs.where(fold("doc_id") != 2), "text", "lang")
    held_out = F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "ambiguous")


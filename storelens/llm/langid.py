"""Language ID with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier
is learned: the log-odds of byte trigrams (lower-cased text) between the
languages with that bit 1 and those with 0, from trigram counts over all
labelled training documents. A document's margin for a bit is its mean
log-odds, scaled and shifted by a logistic fit. Decoding sums, per language,
the logistic loss of the margins against its codeword, each bit weighted by
how well its classifier does on that language's documents; the least loss wins.
Documents without a clear winner are flagged as ambiguous.

Scale: one pass over the training texts makes count vectors per language (a
few KB per task and language, summed in tree order by Spark), one pass
predicts. Scale and weights are fitted on the at most SAMPLE_ROWS training
documents picked by a hash of id and text; that is the only sample here.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F


#: Trigrams are hashed into this many features.
FEATURES = 1 << 13
#: Training documents, at most, on which bit scales and decoding weights are fitted.
SAMPLE_ROWS = 4000
#: Up to this many languages all distinct two-class splits are bits; beyond, random codewords.
EXHAUSTIVE = 6
#: A document whose two best languages have shares this near is ambiguous.
CLEAR = 0.10
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 6) -> np.ndarray:
    """n codewords of 0 and 1, one row each; no bit is constant, no two bits make the same split."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= EXHAUSTIVE:
        splits = [s for s in itertools.product((0, 1), repeat=n - 1) if any(s)]
        return np.array([(0, *s) for s in splits], dtype=np.int8).T
    bits, rng, best, apart = math.ceil(10 * math.log2(n)), np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        code = code[:, (code.sum(0) > 0) & (code.sum(0) < n)]
        distance = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(n, dtype=int) * bits
        if distance.min() > apart:
            best, apart = code, int(distance.min())
    return best


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text with its letters lower-cased, white space as one space."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8"), dtype=np.uint8)
    if len(data) < 3:
        return np.zeros(FEATURES, dtype=np.int64)
    counts = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(data) - 2, 1 << 22):  # bounds the memory of very long texts
        part = data[at : at + (1 << 22) + 2].astype(np.uint32)
        code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=FEATURES)
    return counts


@dataclass
class Model:
    """Learned languages, their codewords, per bit the trigram log-odds with scale and shift, and decoding weights."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    weight: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Scaled margins (rows x bits) of count vectors (rows x features)."""
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        return (counts @ self.odds) / total * self.scale + self.shift

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted mean logistic loss (rows x languages)."""
        sign = 2.0 * self.code - 1.0
        loss = np.logaddexp(0.0, -margins[:, None, :] * sign[None])
        return (loss * self.weight[None]).sum(2) / self.weight.sum(1)[None]

    def decode(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the winner's share of exp(-loss), from 0 to 1) and ambiguity of every row."""
        loss = self.losses(self.margins(counts)) * self.code.shape[1]
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, axis=1)
        second = order[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return [self.languages[i] for i in share.argmax(1)], order[:, -1], order[:, -1] - second < CLEAR


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text is 0 mod 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0



def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One count vector per language and task; its last entry is the number of documents."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang = lang.as_py()
            counts = trigrams(text.as_py() or "")
            # a document weighs by the square root of its length, so that no few texts rule a language
            sums[lang] = sums.get(lang, 0) + counts / math.sqrt(max(1, counts.sum()))
            docs[lang] = docs.get(lang, 0) + 1
    if sums:
        langs = list(sums)
        flat = np.concatenate([np.append(sums[x], docs[x]) for x in langs])
        offsets = np.arange(len(langs) + 1) * (FEATURES + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
            ["lang", "counts"],
        )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from the text and language of labelled documents that are not held out; None if there are none."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    # sums by feature: languages x FEATURES values reach the driver, whatever the number of documents
    per_task = rows.select("lang", "text").mapInArrow(_count_rows, "lang string, counts array<double>")
    summed = (
        per_task.select("lang", F.posexplode("counts").alias("f", "c"))
        .filter("c > 0")
        .groupBy("lang", "f")
        .agg(F.sum("c").alias("c"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("f", "c"))).alias("v"))
        .collect()
    )
    if not summed:
        return None
    summed.sort(key=lambda r: r["lang"])
    languages = [r["lang"] for r in summed]
    share = np.zeros((len(languages), FEATURES + 1))
    for i, r in enumerate(summed):
        for x in r["v"]:
            share[i, x["f"]] = round(x["c"], 6)
    documents, share = share[:, -1].sum(), share[:, :-1]
    share = (share + 0.5) / (share + 0.5).sum(1, keepdims=True)  # languages weigh alike
    code = codewords(len(languages))
    odds = np.zeros((FEATURES, code.shape[1]))
    for j in range(code.shape[1]):
        one, zero = share[code[:, j] == 1], share[code[:, j] == 0]
        if len(one) and len(zero):
            odds[:, j] = np.log(one.mean(0)) - np.log(zero.mean(0))
    ones = np.ones(code.shape[1])
    model = Model(languages, code, odds, ones, 0 * ones, np.ones(code.shape))
    # a hash of id and text picks about four fifths of SAMPLE_ROWS; the limit only matters if many rows are the same
    picked = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) < int(0.8 * SAMPLE_ROWS / documents * 2**40) + 1
    sample = (
        rows.filter(picked).select("lang", "text").mapInArrow(_margin_rows(model), "lang string, m array<double>")
        .limit(SAMPLE_ROWS).collect()
    )
    lang = np.array([languages.index(r["lang"]) for r in sample])
    raw = np.array([r["m"] for r in sample])
    _fit_bits(model, lang, raw)
    return model


def _margin_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                m = model.margins(np.array([trigrams(t.as_py() or "") for t in rows.column("text")]))
                offsets = np.arange(rows.num_rows + 1) * m.shape[1]
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("lang"), values], ["lang", "m"])

    return run


def _fit_bits(model: Model, lang: np.ndarray, raw: np.ndarray) -> None:
    """Scale and shift of each bit by logistic regression on its margin; weights by its success on each language."""
    for j in range(model.code.shape[1]):
        y = model.code[lang, j].astype(float)
        x = raw[:, j]
        if y.min(initial=1) == y.max(initial=0) or x.std() == 0:
            continue
        z = np.stack([(x - x.mean()) / x.std(), np.ones_like(x)], 1)
        b = np.zeros(2)
        for _ in range(25):  # Newton steps with a ridge, which keeps separable bits finite
            p = 1 / (1 + np.exp(-z @ b))
            h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
            b += np.linalg.solve(h, z.T @ (y - p) - 0.1 * b)
        model.scale[j] = b[0] / x.std()
        model.shift[j] = b[1] - b[0] * x.mean() / x.std()
    margins = raw * model.scale + model.shift
    for i in range(len(model.languages)):
        own = margins[lang == i]
        if len(own):
            model.weight[i] = np.maximum(((own > 0) == (model.code[i] == 1)).mean(0), 0.01)


def decide(model: Model | None, texts: Iterable[str]) -> Iterator[tuple[str, float, bool]]:
    """Language, score and ambiguity of each text."""
    texts = iter(texts)
    while some := list(itertools.islice(texts, 64)):
        known = [i for i, t in enumerate(some) if model is not None and LETTER.search(t)]
        out = [(UNDETERMINED, 0.0, False)] * len(some)
        if known:
            found = zip(*model.decode(np.array([trigrams(some[i]) for i in known])), strict=True)
            for i, (lang, score, unsure) in zip(known, found, strict=True):
                out[i] = (lang, float(score), bool(unsure))
        yield from out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, ambiguous.

    ``und`` with score 0 for a null text or one without letters, and for every
    text if nothing was learned. Only the whole text decides. Rows are predicted
    one by one, so ties and repeated rows change nothing; other columns are not
    read; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits x FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, score, unsure = zip(*decide(shared.value, (t.as_py() or "" for t in batch.column("text"))), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    source = docs.select(
        docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text")
    )
    return source.mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predict`` with a model learned from ``docs`` itself (see ``train``)."""
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language cannot be told (``und`` or ambiguous); all columns as they were.

    Rows with a null text or one without letters go, and all rows if nothing was learned. Rows are judged one by one, so
    repeated rows stay or go together; ids may be null; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(at)]
            kept = [lang != UNDETERMINED and not unsure for lang, _, unsure in decide(shared.value, texts)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

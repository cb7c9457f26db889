"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A word is a run of letters, in lower case; its subwords are itself and its character 2- to 4-grams with word marks,
hashed into a fixed number of buckets by array operations over many texts at once. A text is the mean embedding of all
its subwords. The model is trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows; a temperature is fitted on a part of the sample that training doesn't see.

A softmax is sure of texts in no language that it knows, too, so rejection looks at something else: how likely a text's subwords are in the
language that was predicted, as the mean logarithm of their shares there. That part of the sample tells how this varies between texts of a language and
with their length. A text is rejected that lies more deviations below its language's mean than nearly all of them, and at least half as far below as nearly all
strangers: the languages themselves, each as seen by the others (leaving one out), and the texts with their letters replaced at random.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, DIM, EPOCHS, RATE = 15, 16, 6, 2.0
BUCKETS = 1 << BITS
#: Bound on the labelled rows that training takes of each language (in expectation; rows are chosen by a hash of doc_id).
SAMPLE_PER_LANG = 600
#: Characters that are hashed at a time.
GROUP_CHARS = 250_000
#: Subwords of a word overlap, so that about so many tell as much as one; pseudo-texts that stand for a bucket that a language lacks.
OVERLAP, LACKING = 8.0, 0.02
#: Known texts that may be rejected, strangers that lie beyond the quantile that counts for them, deviations that a rejection needs at least,
#: and letters of a scrambled text.
REJECTED, NEAR_STRANGERS, LEAST_DEVIATIONS, STRANGE_CHARS = 0.001, 0.98, 8.5, 400


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _groups(texts: Iterator[str]) -> Iterator[list[tuple[int, str]]]:
    """(number, part) of texts in groups of bounded size; long texts are cut at spaces, or anywhere if there are none."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > GROUP_CHARS:
                end = text.rfind(" ", at + 1, at + GROUP_CHARS)
                end = at + GROUP_CHARS if end < 0 else end
            group.append((i, text[at:end].lower()))
            size += end - at
            if size >= GROUP_CHARS:
                yield group
                group, size = [], 0
            at = end
            if at >= len(text):
                break
    if group:
        yield group


def subwords(parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(part, bucket) of each subword of lower-case texts; once for each kind of subword, parts ascending."""
    points = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(p) + 1 for p in parts])
    is_letter = letters()[points]
    first = is_letter & ~np.concatenate([[False], is_letter[:-1]])
    at = np.flatnonzero(is_letter)
    word = np.cumsum(first)[at] - 1
    if not len(at):
        return
    sizes = np.bincount(word) + 2
    starts = np.cumsum(sizes) - sizes
    # each word as its letters between two marks
    marked = np.zeros(int(sizes.sum()), np.uint32)
    marked[np.arange(len(at)) + 2 * word + 1] = points[at]
    marked[starts], marked[starts + sizes - 1] = ord("<"), ord(">")
    part = np.repeat(np.searchsorted(ends, np.flatnonzero(first), "right"), sizes)
    room = np.repeat(starts + sizes, sizes) - np.arange(len(marked))

    def bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        return ((h ^ h >> np.uint32(12)) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)).astype(np.int64)

    h = marked.copy()
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) ^ marked[n - 1 :]
        fits = room[: len(h)] >= n
        yield part[: len(h)][fits], bucket(h[fits] + np.uint32(n))
    powers = np.cumprod(np.concatenate([[1], np.full(int(sizes.max()) - 1, 0x01000193)]).astype(np.uint32), dtype=np.uint32)
    whole = np.add.reduceat(marked * powers[np.arange(len(marked)) - np.repeat(starts, sizes)], starts, dtype=np.uint32)
    yield part[starts], bucket(whole + np.uint32(1))


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    #: Contribution of each bucket to each language's logit: embeddings times softmax weights.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Logarithms of the buckets' shares in each language; each language's mean of a text's mean logarithm, and its variance for a subword and between texts.
    shares: np.ndarray
    usual: np.ndarray
    #: How many deviations below the mean are too many, and how far below it, in logarithms, a stranger is.
    threshold: float
    apart: float = 0.0
    #: Share of known texts that would be rejected and of strangers that would be accepted, on rows that training doesn't see.
    false_reject: float = 0.0
    false_accept: float = 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def _calibrates(doc_id: int) -> bool:
    """Whether a row of the sample is kept from training, to calibrate on."""
    return zlib.crc32(f"calibrate {doc_id}".encode()) % 5 == 0


def _scrambled(text: str, seed: int) -> str:
    """The text with its letters replaced by random ones of the Latin alphabet; words keep their lengths."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    at = letters()[points]
    points[at] = np.random.default_rng(seed).integers(97, 123, int(at.sum()))
    return points.tobytes().decode("utf-32-le")


def _deviations(means: np.ndarray, n: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """How many deviations a text's mean logarithm lies above (or below) the mean of its language; ``usual`` has a row for each text."""
    return (means - usual[:, 0]) / np.sqrt(usual[:, 1] * OVERLAP / np.maximum(n, 1) + usual[:, 2])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as sparse means of their buckets, at most BUCKETS entries each."""
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "lang": [], "bucket": [], "weight": [], "n": [], "strange": []}
        for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = np.zeros(BUCKETS, np.int64)
            for group in _groups(iter([text])):
                for _, bucket in subwords([p for _, p in group]):
                    counts += np.bincount(bucket, minlength=BUCKETS)
            some = np.flatnonzero(counts)
            if len(some):
                out["doc_id"].append(doc_id)
                out["lang"].append(lang)
                out["bucket"].append(some.astype(np.int32))
                out["weight"].append((counts[some] / counts.sum()).astype(np.float32))
                out["n"].append(int(counts.sum()))
                # only rows that calibrate need a stranger
                found = [b for _, b in subwords([_scrambled(text[:STRANGE_CHARS].lower(), int(counts.sum()))])] if _calibrates(doc_id) else []
                out["strange"].append(np.concatenate(found or [np.zeros(0, np.int64)]).astype(np.int32))
        yield pa.record_batch({"doc_id": pa.array(out["doc_id"], pa.int64()), "lang": pa.array(out["lang"], pa.string()), "bucket": pa.array(out["bucket"], pa.list_(pa.int32())), "weight": pa.array(out["weight"], pa.list_(pa.float32())), "n": pa.array(out["n"], pa.int64()), "strange": pa.array(out["strange"], pa.list_(pa.int32()))})


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from all learning: crc32 of its id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG, seed: int = 7) -> LanguageModel:
    """Fit on a bounded, evenly hashed sample of the rows with a language that aren't held out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    scale = 1 << 30
    for name, n in sorted(sizes.items()):
        chosen |= (F.col("lang") == name) & (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(scale)) < min(scale, int(scale * per_lang / n)))
    sample = rows.filter(chosen).mapInArrow(_features, "doc_id long, lang string, bucket array<int>, weight array<float>, n long, strange array<int>").toArrow() if sizes else None
    if sample is None or not sample.num_rows:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, np.zeros((BUCKETS, 0)), np.zeros((0, 3)), 0.0)
    sample = sample.sort_by([("doc_id", "ascending"), ("lang", "ascending")]).combine_chunks()
    names, ids = sample["lang"].to_pylist(), sample["doc_id"].to_pylist()
    buckets, shares = ([x.values.to_numpy(zero_copy_only=False) for x in sample[c]] for c in ("bucket", "weight"))
    langs = tuple(sorted(set(names)))
    y = np.array([langs.index(x) for x in names])
    rng = np.random.default_rng(seed)
    embed, weights, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    apart = np.array([_calibrates(i) for i in ids])
    if apart.all() or not apart.any():
        apart = np.zeros(len(ids), bool)
    learn = np.flatnonzero(~apart)
    mean_embed, mean_weights, mean_bias, steps = np.zeros_like(embed), np.zeros_like(weights), np.zeros_like(bias), 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            b, w = buckets[i], shares[i].astype(float)
            hidden = w @ embed[b]
            off = softmax(hidden @ weights + bias)
            off[y[i]] -= 1
            back = weights @ off
            weights -= rate * np.outer(hidden, off)
            bias -= 0.05 * rate * off
            embed[b] -= rate * np.outer(w, back)
        if epoch >= EPOCHS // 2:
            mean_embed += embed
            mean_weights += weights
            mean_bias += bias
            steps += 1
    embed, weights, bias = mean_embed / steps, mean_weights / steps, mean_bias / steps
    logits = embed @ weights
    check = np.flatnonzero(apart) if apart.any() else learn
    z = np.stack([shares[i].astype(float) @ logits[buckets[i]] + bias for i in check])
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    counted = sample["n"].to_numpy()
    total = np.zeros((BUCKETS, len(langs)))
    for i in learn:
        np.add.at(total[:, y[i]], buckets[i], shares[i])
    shares_of = np.log((total + LACKING / BUCKETS) / (total.sum(axis=0) + LACKING))
    means = np.stack([shares[i].astype(float) @ shares_of[buckets[i]] for i in check])
    own, n = means[np.arange(len(check)), y[check]], counted[check].astype(float)
    usual = np.zeros((len(langs), 3))
    p = np.exp(shares_of)
    for j in range(len(langs)):
        at = y[check] == j
        spread = float((p[:, j] * (shares_of[:, j] - (p[:, j] * shares_of[:, j]).sum()) ** 2).sum())
        # a language with hardly a text apart is taken to vary as the mean of all
        mean = own[at].mean() if at.any() else own.mean()
        between = np.mean((own[at] - mean) ** 2 - spread * OVERLAP / n[at]) if at.sum() > 2 else 0.0
        usual[j] = mean, spread, max(float(between), 0.01)
    known = _deviations(own, n, usual[y[check]])
    # strangers: each language as the likeliest of the others sees it, and scrambled letters
    others = z.copy()
    others[np.arange(len(check)), y[check]] = -np.inf
    seen_as = others.argmax(axis=1)
    strange = [(means[np.arange(len(check)), seen_as], n, usual[seen_as])] if len(langs) > 1 else []
    letters_of = [x.values.to_numpy(zero_copy_only=False) for x in sample["strange"]]
    some = [i for i in check if len(letters_of[i]) > 4 * OVERLAP]
    if some:
        as_lang = np.array([(logits[letters_of[i]].mean(axis=0) + bias).argmax() for i in some])
        strange.append((np.array([shares_of[letters_of[i], k].mean() for i, k in zip(some, as_lang, strict=True)]), np.array([len(letters_of[i]) for i in some], float), usual[as_lang]))
    threshold = min(float(np.quantile(known, REJECTED)), -LEAST_DEVIATIONS)
    below = np.concatenate([m - u[:, 0] for m, _, u in strange]) if strange else np.zeros(0)
    apart_by = min(0.0, float(np.quantile(below, NEAR_STRANGERS))) / 2 if len(below) else 0.0
    goes = lambda m, n, u: (_deviations(m, n, u) < threshold) & (m - u[:, 0] < apart_by)
    accepted = float(1 - np.concatenate([goes(*x) for x in strange]).mean()) if strange else 0.0
    return LanguageModel(langs, logits, bias, temperature, shares_of, usual, threshold, apart_by, float(goes(own, n, usual[y[check]]).mean()), accepted)


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = LanguageModel(*shared.value)
    k = len(model.langs)
    for batch in batches:
        n = batch.num_rows
        sums, likely, counts = np.zeros((n, k)), np.zeros((n, k)), np.zeros(n)
        for group in _groups(x.as_py() or "" for x in batch.column(1)):
            rows = np.array([i for i, _ in group])
            for part, bucket in subwords([p for _, p in group]):
                np.add.at(counts, rows, np.bincount(part, minlength=len(rows)))
                for j in range(k):
                    np.add.at(sums[:, j], rows, np.bincount(part, weights=model.logits[bucket, j], minlength=len(rows)))
                    np.add.at(likely[:, j], rows, np.bincount(part, weights=model.shares[bucket, j], minlength=len(rows)))
        if k:
            p = softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature)
            best, score = p.argmax(axis=1), p.max(axis=1)
            mean = likely[np.arange(n), best] / np.maximum(counts, 1)
            strange = (_deviations(mean, counts, model.usual[best]) < model.threshold) & (mean - model.usual[best, 0] < model.apart)
        else:
            best, score, strange = np.zeros(n, int), np.zeros(n), np.ones(n, bool)
        known = (counts > 0) & (k > 0)
        langs = [model.langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
        added = [pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | strange)]
        yield pa.record_batch([*batch.columns[:1], *batch.columns[2:], *added], names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of ``docs``, from its whole text alone.

    A text that is null or has no letter gets ``und`` with score 0 and is rejected, as is any text whose subwords are too unlikely in
    the language that it is likest to (its lang_pred and score are still that language's). Ties go to the
    first language in order. With no labelled row to learn from all is ``und``. Repeated rows give repeated rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    return rows.mapInArrow(partial(_predict, shared=shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """Train on the labelled rows of ``docs`` that aren't held out, then predict all of them (see ``predict``)."""
    return predict(docs, train(docs, doc_id, text, lang, per_lang), doc_id, text)


def keep_identified(docs: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` whose text isn't rejected, with all their columns and repeats."""
    model = train(docs, text=text, **names)
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            ids = pa.array(range(batch.num_rows), pa.int64())
            said = next(_predict(iter([pa.record_batch({"doc_id": ids, "text": batch.column(at)})]), shared))
            yield batch.filter(pc.invert(said.column("rejected")))

    return docs.mapInArrow(keep, docs.schema)

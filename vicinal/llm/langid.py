"""Language of whole texts by a small convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.frames import small_side
from vicinal.llm.tokens import chunks
from vicinal.plans.sizing import cut_lineage

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Shape and training of the network.

    ``per_lang`` documents of every language at most (chosen by a hash of their ids) and
    ``per_text`` windows of each, dealt over the whole text, are the training sample.
    """

    window: int = 128
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    per_lang: int = 300
    per_text: int = 6
    epochs: int = 8
    batch: int = 64
    rate: float = 4e-3
    seed: int = 5


SETTINGS = Settings()
#: Windows worked on at once.
WINDOWS = 1024


def windows_of(data: np.ndarray, size: int) -> np.ndarray:
    """All bytes of a text in rows of ``size``; the last row is filled up with zeros."""
    rows = max(1, -(-len(data) // size))
    found = np.zeros(rows * size, np.uint8)
    found[: len(data)] = data
    return found.reshape(rows, size)


class ByteNet:
    """Byte embedding, convolutions of several widths, max pooling over the window, softmax."""

    def __init__(self, settings: Settings, langs: list[str]):
        self.settings, self.langs = settings, langs
        rng = np.random.default_rng(settings.seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        e, f = settings.embedding, settings.filters
        self.weights = {"embed": normal(256, e, scale=0.3)}
        for w in settings.widths:
            self.weights[f"conv{w}"] = normal(w * e, f, scale=(w * e) ** -0.5)
            self.weights[f"bias{w}"] = np.zeros(f, np.float32)
        inner = f * len(settings.widths)
        self.weights["out"] = normal(inner, len(langs), scale=inner**-0.5)
        self.weights["out_bias"] = np.zeros(len(langs), np.float32)

    def _pooled(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, size = x.shape
        e = self.settings.embedding
        flat = self.weights["embed"][x].reshape(n, size * e)
        found = []
        for w in self.settings.widths:
            places = size - w + 1
            # Overlapping views stand for the ``w`` bytes from each place on.
            view = np.lib.stride_tricks.as_strided(
                flat, (n, places, w * e), (flat.strides[0], flat.strides[1] * e, flat.strides[1])
            )
            scores = np.ascontiguousarray(view).reshape(n * places, w * e) @ self.weights[f"conv{w}"]
            scores = scores.reshape(n, places, -1)
            best = scores.argmax(1) if keep is not None else None
            top = scores.max(1) + self.weights[f"bias{w}"]
            if keep is not None:
                keep.append((view, best, top))
            found.append(np.maximum(top, 0))
        return np.concatenate(found, 1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = self._pooled(x) @ self.weights["out"] + self.weights["out_bias"]
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: list = []
        n, f, e = len(x), self.settings.filters, self.settings.embedding
        hidden = self._pooled(x, kept)
        scores = hidden @ self.weights["out"] + self.weights["out_bias"]
        scores = np.exp(scores - scores.max(1, keepdims=True))
        error = scores / scores.sum(1, keepdims=True)
        error[np.arange(n), y] -= 1
        error /= n
        found = {"out": hidden.T @ error, "out_bias": error.sum(0), "embed": np.zeros_like(self.weights["embed"])}
        back = error @ self.weights["out"].T
        for i, w in enumerate(self.settings.widths):
            view, best, top = kept[i]
            d = back[:, i * f : (i + 1) * f] * (top > 0)
            chosen = view[np.arange(n)[:, None], best]  # text, filter, bytes in sight
            found[f"conv{w}"] = np.einsum("nfk,nf->kf", chosen, d)
            found[f"bias{w}"] = d.sum(0)
            seen = (d[:, :, None] * self.weights[f"conv{w}"].T[None]).reshape(n, f, w, e)
            places = best[:, :, None] + np.arange(w)
            symbols = np.take_along_axis(x, places.reshape(n, -1), 1).reshape(-1)
            np.add.at(found["embed"], symbols, seen.reshape(-1, e))
        return found

    def train(self, x: np.ndarray, y: np.ndarray) -> ByteNet:
        """Fit by Adam on ``(windows, language numbers)``; the seed fixes the order."""
        s = self.settings
        rng = np.random.default_rng(s.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), s.batch):
                step += 1
                rows = order[at : at + s.batch]
                for k, g in self._gradients(x[rows], y[rows]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    lift = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - s.rate * lift).astype(np.float32)
        return self

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number and probability of each text, from the mean over all its windows.

        A window weighs by the bytes it holds.  Only ``WINDOWS`` windows are in memory at once.
        """
        size, count = self.settings.window, len(texts)
        sums, total = np.zeros((count, len(self.langs))), np.zeros(count)
        for first, data, at in chunks(texts):
            rows = -(-np.diff(at) // size)
            row_at = np.concatenate([[0], np.cumsum(rows)])
            for a in range(0, row_at[-1], WINDOWS):
                row = np.arange(a, min(a + WINDOWS, row_at[-1]))
                own = np.searchsorted(row_at, row, "right") - 1
                begin = at[own] + (row - row_at[own]) * size
                held = np.minimum(at[own + 1] - begin, size)
                x = np.take(data, begin[:, None] + np.arange(size), mode="clip")
                x[np.arange(size) >= held[:, None]] = 0
                weight = held / size
                np.add.at(sums, first + own, self.log_probabilities(x) * weight[:, None])
                np.add.at(total, first + own, weight)
        mean = np.exp(sums / np.maximum(total, 1 / size)[:, None])
        mean /= mean.sum(1, keepdims=True)
        best = mean.argmax(1)
        return best, mean[np.arange(count), best]


def training_sample(labelled: DataFrame, settings: Settings) -> DataFrame:
    """At most ``per_lang`` rows ``text, lang`` of every language, by a hash of id and text.

    A share of each language is drawn that holds twice as many on average, so that a
    language with a third of all rows sends no more than a small one; the lowest hashes of
    those are taken.
    """
    rows = labelled.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    counts = cut_lineage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("k")))
    share = F.col("k").cast("double") * F.pmod("h", F.lit(1 << 30)) <= F.lit(2.0 * settings.per_lang * (1 << 30))
    drawn = rows.join(small_side(counts), "lang").filter(share)
    rank = F.expr("row_number() OVER (PARTITION BY lang ORDER BY h, text)")
    return drawn.select("lang", "text", "h", rank.alias("rank")).filter(F.col("rank") <= settings.per_lang)


def fit(labelled: DataFrame, settings: Settings = SETTINGS) -> ByteNet | None:
    """A network for the languages of ``doc_id, text, lang``; None if there are none.

    The driver receives windows of the sample only, ``per_lang * per_text`` of each language.
    """
    sample = training_sample(labelled.filter("lang IS NOT NULL AND text IS NOT NULL"), settings)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes, found = [], [], []
            for lang, text, h in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "h"))):
                rows = windows_of(np.frombuffer(text.encode(), np.uint8), settings.window)
                take = np.unique(np.linspace(0, len(rows) - 1, settings.per_text).astype(int))
                found += [r.tobytes() for r in rows[take]]
                langs += [lang] * len(take)
                hashes += [h] * len(take)
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], names=["lang", "h", "bytes"])

    rows = sample.mapInArrow(cut, "lang string, h bigint, bytes binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["h"], r["bytes"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    x = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8).reshape(len(rows), settings.window)
    number = {lang: i for i, lang in enumerate(langs)}
    return ByteNet(settings, langs).train(x, np.array([number[r["lang"]] for r in rows]))


def identify(docs: DataFrame, net: ByteNet | None, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``lang_pred`` and ``score`` for its ``text``.

    A null text and one without a letter get ``und`` and 0, and so does every text if nothing
    was learned.  The whole text is read.  The result depends on the text alone.
    """
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable = batch.column("_known").to_numpy(zero_copy_only=False)
            langs, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            if net is not None and usable.any():
                at = np.flatnonzero(usable)
                best, score = net.predict(batch.column("text").take(pa.array(at)))
                for i, b in zip(at.tolist(), best.tolist()):
                    langs[i] = net.langs[b]
                scores[at] = np.round(np.clip(score, 0, 1), 6)
            rest = [batch.column(c) for c in columns]
            yield pa.record_batch([*rest, pa.array(langs, pa.string()), pa.array(scores)], names=[*columns, "lang_pred", "score"])

    source = docs.select(*columns, "text", known)
    schema = source.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(run, schema)


def language_report(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the rows not held out.

    A row is held out if the CRC of its id (as text) leaves 1 modulo 3; a null id is not.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    marked = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    net = fit(marked.filter("NOT held_out").select("doc_id", "text", "lang"), settings)
    return identify(marked, net, ["doc_id", "held_out"])

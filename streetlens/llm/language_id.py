"""Language identification by a byte convolutional network, trained here in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.arrays import chunks, mixed, text_bytes
from streetlens.llm.columns import as_row, row_type
from streetlens.llm.sampling import bounded_sample

WIDTHS, FILTERS, EMBEDDING, WINDOW = (2, 3, 4), 16, 8, 256

#: Labelled rows the network is fitted on at most (those with the smallest hashed ids), and windows of each.
TRAIN_ROWS, TRAIN_WINDOWS = 4000, 2


def has_letter(text: str | None) -> bool:
    """Whether some sign is a letter: numbers such as superscripts, fractions and Roman ones are none."""
    return any(map(str.isalpha, text or ""))


def windows_of(data: np.ndarray, start: int, end: int, window: int) -> np.ndarray:
    """Windows that cover a text one after another, the last one filled up with zeros."""
    size = end - start
    rows = max(1, -(-size // window))
    out = np.zeros(rows * window, np.uint8)
    out[:size] = data[start:end]
    return out.reshape(rows, window)


def training_windows(data: bytes) -> list[bytes]:
    """At most ``TRAIN_WINDOWS`` windows with a letter, from the whole text: those of smallest hashed number."""
    count = max(1, -(-len(data) // WINDOW))
    order = np.argsort(mixed(np.arange(count, dtype=np.uint64) + np.uint64(zlib.crc32(data))), kind="stable")
    drawn: list[bytes] = []
    for i in order:
        part = data[i * WINDOW:(i + 1) * WINDOW]
        if has_letter(part.decode(errors="ignore")):
            drawn.append(part)
            if len(drawn) == TRAIN_WINDOWS:
                break
    # every letter may be cut by the end of a window
    return drawn or [data[i * WINDOW:(i + 1) * WINDOW] for i in order[:TRAIN_WINDOWS]]


def drawer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the training windows of each text in place of the text."""
    for batch in chunks(batches, "text"):
        drawn = [training_windows(t.encode()) for t in batch.column("text").to_pylist()]
        columns = [pa.array(drawn, pa.list_(pa.binary())) if name == "text" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def init(languages: int, seed: int) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    net = {"embedding": random.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
    for w in WIDTHS:
        net[f"filter{w}"] = random.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)).astype(np.float32)
        net[f"bias{w}"] = np.zeros(FILTERS, np.float32)
    net["out"] = random.normal(0, 0.1, (len(WIDTHS) * FILTERS, languages)).astype(np.float32)
    net["out_bias"] = np.zeros(languages, np.float32)
    return net


def patches(x: np.ndarray, w: int) -> np.ndarray:
    """[rows, window, embedding] to [rows, window - w + 1, w * embedding]."""
    n = x.shape[1] - w + 1
    return np.concatenate([x[:, i:i + n] for i in range(w)], axis=2)


def step(net: dict[str, np.ndarray], rows: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the cross entropy of a batch of windows."""
    x = net["embedding"][rows]
    seen, pooled, best = {}, [], {}
    for w in WIDTHS:
        seen[w] = patches(x, w)
        response = seen[w] @ net[f"filter{w}"]
        best[w] = response.argmax(axis=1)
        pooled.append(np.maximum(np.take_along_axis(response, best[w][:, None], axis=1)[:, 0] + net[f"bias{w}"], 0))
    hidden = np.concatenate(pooled, axis=1)
    logits = hidden @ net["out"] + net["out_bias"]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(rows)), label] -= 1
    p /= len(rows)
    grad = {"out": hidden.T @ p, "out_bias": p.sum(axis=0), "embedding": np.zeros_like(net["embedding"])}
    back = (p @ net["out"].T) * (hidden > 0)
    at = np.arange(len(rows))
    for i, w in enumerate(WIDTHS):
        g = back[:, i * FILTERS:(i + 1) * FILTERS]
        grad[f"bias{w}"] = g.sum(axis=0)
        chosen = seen[w][at[:, None], best[w]]
        grad[f"filter{w}"] = np.einsum("nfk,nf->kf", chosen, g)
        into = np.einsum("nf,kf->nfk", g, net[f"filter{w}"]).reshape(-1, w, EMBEDDING)
        bytes_ = rows[at[:, None, None], best[w][:, :, None] + np.arange(w)].reshape(-1, w)
        np.add.at(grad["embedding"], bytes_.ravel(), into.reshape(-1, EMBEDDING))
    return grad


def fit(texts: list[str], labels: np.ndarray, languages: int, epochs: int = 6, batch: int = 64, seed: int = 7) -> dict[str, np.ndarray]:
    """The network fitted on the training windows of whole texts."""
    return fit_windows([training_windows(t.encode()) for t in texts], labels, languages, epochs, batch, seed)


def fit_windows(
    drawn: list[list[bytes]], labels: np.ndarray, languages: int, epochs: int = 6, batch: int = 64, seed: int = 7,
) -> dict[str, np.ndarray]:
    """Adam on the windows of each text; half of them are cut short, so that short texts are known too."""
    random = np.random.default_rng(seed)
    net = init(languages, seed)
    rows, label = [], []
    for parts, y in zip(drawn, labels, strict=True):
        for part in parts:
            for size in (WINDOW, int(np.exp(random.uniform(np.log(12), np.log(WINDOW))))):
                row = np.zeros(WINDOW, np.uint8)
                row[:min(size, len(part))] = np.frombuffer(part[:size], np.uint8)
                rows.append(row)
                label.append(y)
    rows, label = np.array(rows), np.array(label)
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    t, total = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            t += 1
            some = order[start:start + batch]
            rate = 0.004 * (1 - t / (total + 1))
            for k, g in step(net, rows[some], label[some]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                net[k] -= (rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def tables(net: dict[str, np.ndarray]) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """The same convolutions as sums of table look-ups: each filter's response to a byte, or a pair, at each place."""
    out = []
    for w in WIDTHS:
        single = [net["embedding"] @ net[f"filter{w}"][i * EMBEDDING:(i + 1) * EMBEDDING] for i in range(w)]
        looked = [(single[i][:, None] + single[i + 1][None]).reshape(1 << 16, FILTERS) for i in range(0, w - 1, 2)]
        out.append((looked + ([single[-1]] if w % 2 else []), net[f"bias{w}"]))
    return out


def responses(rows: np.ndarray, looked: list, net: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of a batch of windows."""
    pairs = (rows[:, :-1].astype(np.uint16) << 8) | rows[:, 1:]
    pooled = []
    for w, (parts, bias) in zip(WIDTHS, looked, strict=True):
        n = rows.shape[1] - w + 1
        total = parts[0][pairs[:, :n]]
        for i, part in enumerate(parts[1:], 1):
            total += part[pairs[:, 2 * i:2 * i + n] if len(part) > 256 else rows[:, 2 * i:2 * i + n]]
        pooled.append(np.maximum(total.max(axis=1) + bias, 0))
    return np.concatenate(pooled, axis=1) @ net["out"] + net["out_bias"]


def predictor(net: dict[str, np.ndarray] | None, languages: list[str]):
    """Task: log probabilities of all windows of a text, weighted by their bytes, give its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = tables(net) if net else []
        for batch in chunks(batches, "text"):
            n = batch.num_rows
            known = np.array([has_letter(t) for t in batch.column("text").to_pylist()], bool)
            names, score = np.full(n, "und", object), np.zeros(n)
            if net and known.any():
                data, offsets = text_bytes(batch.column("text"))
                some = np.flatnonzero(known)
                sizes = np.diff(offsets)[some]
                count = -(-sizes // WINDOW)
                first = np.cumsum(count) - count
                rows = np.zeros((int(count.sum()), WINDOW), np.uint8)
                for i, at in zip(some, first, strict=True):
                    part = windows_of(data, offsets[i], offsets[i + 1], WINDOW)
                    rows[at:at + len(part)] = part
                logs = np.empty((len(rows), len(languages)))
                for a in range(0, len(rows), 256):
                    logit = responses(rows[a:a + 256], looked, net).astype(float)
                    logit -= logit.max(axis=1, keepdims=True)
                    logs[a:a + 256] = logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))
                weight = np.full(len(rows), float(WINDOW))
                weight[first + count - 1] = sizes - (count - 1) * WINDOW
                total = np.add.reduceat(logs * weight[:, None], first, axis=0) / sizes[:, None]
                total = np.exp(total - total.max(axis=1, keepdims=True))
                total /= total.sum(axis=1, keepdims=True)
                names[some] = np.array(languages, object)[total.argmax(axis=1)]
                score[some] = total.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return run


def trained_network(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, np.ndarray] | None, list[str]]:
    """Network fitted on at most ``rows`` rows of ``doc_id``, ``text``, ``lang``: those of smallest hashed id.

    Rows without text, letters or language teach nothing. Without any other row there is no network.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    shaped = "doc_id {}, lang {}, text array<binary>, sample_order bigint".format(*(usable.schema[c].dataType.simpleString() for c in ("doc_id", "lang")))
    sample = bounded_sample(
        usable.select("doc_id", "lang", "text"), rows, shape=lambda some: some.mapInArrow(drawer, shaped))
    found = sample.column("lang").to_pylist()
    languages = sorted(set(found))
    if not found:
        return None, languages
    label = np.array([languages.index(x) for x in found])
    return fit_windows(sample.column("text").to_pylist(), label, len(languages)), languages


def identify_language(docs: DataFrame, labelled: DataFrame, keep: list[str] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """Language of every whole text: the struct ``row`` with the columns ``keep`` beside ``lang_pred`` and ``score``.

    The network sees bytes of the text only: filters over 2, 3 and 4 bytes, max pooling over a window of 256
    bytes, softmax over the languages of ``labelled`` (``doc_id``, ``text``, ``lang``). It is fitted on a bounded
    sample of those (``rows``; of each some windows with a letter, drawn from the whole text) and applied to all windows of each text.
    ``score`` is the share of the predicted language. A text that is null or has no letter, and every text
    where nothing is labelled, gets ``und`` with score 0. Repeated rows are predicted each. No shuffle of texts.
    """
    net, languages = trained_network(labelled, rows)
    chosen = docs.select(as_row(keep or ["doc_id"]), "text")
    kind = row_type(chosen)
    return chosen.mapInArrow(predictor(net, languages), f"row {kind}, lang_pred string, score double")

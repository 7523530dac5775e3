"""Language of a text by a convolutional network over its bytes.

Bytes are embedded, filters of several widths slide over windows of fixed length, the largest answer of each filter in a window goes to
a softmax over the languages. The network is trained in numpy on the driver, on a bounded sample of labelled texts (``max_rows``
rows in all, spread evenly over the languages and chosen by a hash; a documented bound, as more rows do not change so small a network). Prediction
covers the whole of every text: all its windows, their probabilities averaged by length.

For prediction, embedding and filter are multiplied once: a filter's answer is then a sum of table look-ups, one for each byte it covers.

Defined results: null text and text without a letter are ``und`` with score 0, as are all texts when no labelled row was given. Short
texts are one padded window. A null id is not held out and not learned from. Repeated rows give repeated rows, an empty table an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import keyed, ship, slices

WINDOW = 128
WIDTHS = (2, 3, 4)


def has_letter(text: str | None) -> bool:
    """Numbers such as superscripts or Roman numerals are no letters."""
    return bool(text) and any(map(str.isalpha, text))
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    tables: dict[int, list[np.ndarray]]  # by width, for each byte of the filter: 256 x filters
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        """Softmax of each row of ``windows`` (bytes, ``WINDOW`` wide)."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), batch):
            w = windows[at:at + batch]
            pooled = []
            for width, tables in self.tables.items():
                n = WINDOW - width + 1
                x = tables[0][w[:, :n]]
                for j in range(1, width):
                    x += tables[j][w[:, j:j + n]]
                pooled.append(x.max(1))
            z = np.maximum(np.concatenate(pooled, 1), 0) @ self.weights + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[at:at + batch] = z / z.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text, over all its windows."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        data = {k: t.encode("utf-8", "replace") for k, t in enumerate(texts) if has_letter(t)}
        if not data:
            return out
        counts = [-(-len(b) // WINDOW) for b in data.values()]
        flat = b"".join([b.ljust(n * WINDOW, b"\0") for b, n in zip(data.values(), counts, strict=True)])
        weight = np.full(sum(counts), WINDOW, np.float64)
        ends = np.cumsum(counts)
        weight[ends - 1] = [len(b) - (n - 1) * WINDOW for b, n in zip(data.values(), counts, strict=True)]
        p = self.probabilities(np.frombuffer(flat, np.uint8).reshape(-1, WINDOW)) * weight[:, None]
        mean = np.add.reduceat(p, ends - counts, axis=0) / np.add.reduceat(weight, ends - counts)[:, None]
        best = mean.argmax(1)
        for row, k in enumerate(data):
            out[k] = self.languages[best[row]], round(min(1.0, float(mean[row, best[row]])), 6)
        return out


def windows_of(texts: list[str], labels: list[int], per_text: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rows, of = [], []
    for text, label in zip(texts, labels, strict=True):
        b = text.encode("utf-8", "replace")
        for at in range(0, min(len(b), per_text * WINDOW), WINDOW):
            rows.append(b[at:at + WINDOW].ljust(WINDOW, b"\0"))
            of.append(label)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(of)


def fit(texts: list[str], langs: list[str], filters: int = 12, depth: int = 8, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Train on labelled texts by Adam; the same rows in the same order give the same network."""
    languages = sorted(set(langs))
    if not languages:
        return Network([], {}, np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    x, y = windows_of(texts, [languages.index(v) for v in langs])
    p = {"e": rng.normal(0, 0.5, (256, depth)), "v": rng.normal(0, 0.2, (filters * len(WIDTHS), len(languages))), "c": np.zeros(len(languages))}
    p |= {f"w{k}": rng.normal(0, 1 / np.sqrt(k * depth), (k * depth, filters)) for k in WIDTHS} | {f"b{k}": np.zeros(filters) for k in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    share = np.bincount(y, minlength=len(languages)) / len(y)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            take = order[at:at + batch]
            w, n = x[take], len(take)
            emb = p["e"][w]
            pooled, best, cols = [], [], []
            for k in WIDTHS:
                c = np.concatenate([emb[:, j:WINDOW - k + 1 + j] for j in range(k)], 2)
                h = c @ p[f"w{k}"] + p[f"b{k}"]
                top = h.argmax(1)
                pooled.append(np.take_along_axis(h, top[:, None], 1)[:, 0])
                best.append(top)
                cols.append(c)
            a = np.concatenate(pooled, 1)
            r = np.maximum(a, 0)
            z = r @ p["v"] + p["c"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), y[take]] -= 1
            q *= (1 / (share[y[take]] * len(languages)))[:, None].astype(np.float32) / n  # languages weigh the same
            g = {"v": r.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
            back = (q @ p["v"].T) * (a > 0)
            for i, k in enumerate(WIDTHS):
                d = back[:, i * filters:(i + 1) * filters]
                chosen = cols[i][np.arange(n)[:, None], best[i]]
                g[f"w{k}"] = np.einsum("nfk,nf->kf", chosen, d)
                g[f"b{k}"] = d.sum(0)
                down = d[:, :, None] * p[f"w{k}"].T[None]
                for j in range(k):
                    np.add.at(g["e"], w[np.arange(n)[:, None], best[i] + j], down[:, :, j * depth:(j + 1) * depth])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    tables = {k: [np.ascontiguousarray(p["e"] @ p[f"w{k}"][j * depth:(j + 1) * depth]) for j in range(k)] for k in WIDTHS}
    for k in WIDTHS:
        tables[k][0] = tables[k][0] + p[f"b{k}"]
    return Network(languages, tables, p["v"], p["c"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, max_rows: int = 6000, chars: int = 400) -> tuple[list[str], list[str]]:
    """At most about ``max_rows`` pieces of labelled text, evenly over the languages, in a fixed order; ``docs``: ``id, text, lang``."""
    known = docs.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    each = max(1, max_rows // len(counts))
    h = F.xxhash64("id", "text")
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1_000_000, -(-each * 1_000_000 // n)))))
    picked = known.withColumn("h", h).where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")])
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("text") - chars)).cast("int")
    rows = picked.select("h", "lang", F.col("text").substr(start + F.lit(1), F.lit(chars)).alias("text")).collect()
    rows = sorted(r for r in rows if has_letter(r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 6000) -> DataFrame:
    """``id, held_out, lang_pred, score`` of every row; learned from the rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    network = fit(*training_rows(keyed(docs, id_col, text_col, "text", lang_col, "lang"), max_rows))
    shared = spark.sparkContext.broadcast(network)  # some thousand numbers
    rows = keyed(docs, id_col, text_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=64, nbytes=1 << 20):
            found = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "lang_pred", "score"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score")

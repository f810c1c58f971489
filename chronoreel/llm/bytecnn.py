"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

Network. A text's UTF-8 bytes are cut into chunks of CHUNK bytes overlapping by OVERLAP, which cover the whole document. Bytes are
embedded, FILTERS learned filters of WIDTH bytes slide over each chunk by STRIDE, and each filter's greatest response in the chunk is
kept (rectified). A document is the mean and the greatest of its chunks' responses; one logistic unit turns these into a probability.

Training. At most SAMPLE labelled documents, those with the least MD5 of doc_id among rows whose crc32(doc_id) mod 3 is not 1, with their
whole texts; Adam, fixed seed. Every fifth of them is set aside, and of all epochs the weights with the least loss on these are used; training ends
when PATIENCE epochs brought nothing. Only bytes are inputs. The number of labelled rows is the only bound; scoring reads every byte of every
document. Filter responses come from per-offset tables of 256 bytes, and long texts are taken in slices of chunks.

Nulls and odd input: null and empty texts are scored as one empty chunk; labels that are null are not learned from, the least label of
a repeated doc_id is, with one text of its rows, the same in every run; with no labels every score is 0.5; equal texts get equal scores; an empty table gives an empty result;
a null doc_id counts as not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, WIDTH, STRIDE, EMBED, FILTERS = 128, 16, 8, 2, 8, 24
SAMPLE, EPOCHS, BATCH, RATE, SEED = 4000, 8, 32, 0.004, 7
#: Steps that a training without early end takes at least, however few labels there are, and epochs without gain that end it.
LEAST_STEPS, PATIENCE = 900, 4
#: Chunks scored at once, and chunks whose windows are held at once for gradients.
AT_ONCE, SLICE = 4096, 1024
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunk_bytes(data: bytes) -> np.ndarray:
    """All chunks of a text, the last padded with zero bytes."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    flat = np.zeros((n - 1) * step + CHUNK, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


class Net:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)).astype(f32), "w": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(f32), "b": np.zeros(FILTERS, f32),
            "v": np.zeros(2 * FILTERS, f32), "c": np.zeros(1, f32),
        }
        self.trained = False

    def strongest(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, CHUNK) bytes -> each filter's greatest response without bias, and the first position that has it, by table look-up."""
        tables = np.einsum("xe,jef->jxf", self.p["e"], self.p["w"].reshape(WIDTH, EMBED, FILTERS))
        out, top = np.empty((len(chunks), FILTERS), tables.dtype), np.empty((len(chunks), FILTERS), np.int64)
        for at in range(0, len(chunks), 256):
            part = chunks[at : at + 256]
            total = tables[0][part[:, 0 : STRIDE * POSITIONS : STRIDE]]
            for j in range(1, WIDTH):
                total += tables[j][part[:, j : j + STRIDE * POSITIONS : STRIDE]]
            top[at : at + 256] = total.argmax(1)
            out[at : at + 256] = np.take_along_axis(total, top[at : at + 256, None], 1)[:, 0]
        return out, top

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(n, CHUNK) bytes -> (n, FILTERS) greatest rectified responses."""
        tables = np.einsum("xe,jef->jxf", self.p["e"], self.p["w"].reshape(WIDTH, EMBED, FILTERS))
        out = np.empty((len(chunks), FILTERS), np.float32)
        for at in range(0, len(chunks), 256):
            part = chunks[at : at + 256]
            total = tables[0][part[:, 0 : STRIDE * POSITIONS : STRIDE]]
            for j in range(1, WIDTH):
                total += tables[j][part[:, j : j + STRIDE * POSITIONS : STRIDE]]
            out[at : at + 256] = total.max(1)
        return np.maximum(out + self.p["b"], 0)

    def score(self, responses: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Chunk responses of several documents, of which starts are the first chunks, to probabilities."""
        n = np.diff(np.append(starts, len(responses)))[:, None]
        doc = np.concatenate([np.add.reduceat(responses.astype(np.float64), starts) / n, np.maximum.reduceat(responses, starts)], 1)
        return 1 / (1 + np.exp(-np.clip(doc @ self.p["v"] + self.p["c"][0], -30, 30)))

    def gradients(self, docs: list[np.ndarray], y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean log loss over documents (chunk matrices) with labels y, and that loss."""
        p = self.p
        x, count = np.concatenate(docs), np.array([len(d) for d in docs])
        starts, owner, n = np.cumsum(count) - count, np.repeat(np.arange(len(docs)), count), count[:, None]
        value, top = self.strongest(x)
        a = value + p["b"]
        h = np.maximum(a, 0)
        most = np.maximum.reduceat(h, starts)
        doc = np.concatenate([np.add.reduceat(h, starts) / n, most], 1)
        z = np.clip(doc @ p["v"] + p["c"], -30, 30)
        loss = float(np.mean(np.log1p(np.exp(-z)) + (1 - y) * z))
        err = (1 / (1 + np.exp(-z)) - y) / len(docs)
        g_doc = err[:, None] * p["v"]
        is_most = ((h == most[owner]) & (h > 0)).astype(a.dtype)
        ties = np.maximum(np.add.reduceat(is_most, starts), 1)  # overlapping chunks hold some windows twice
        g_h = (g_doc[:, :FILTERS] / n)[owner] + (g_doc[:, FILTERS:] / ties)[owner] * is_most
        g_a = np.where(a > 0, g_h, 0).astype(a.dtype)
        g = {"v": doc.T @ err, "c": np.array([err.sum()]), "b": g_a.sum(0), "w": np.zeros_like(p["w"]), "e": np.zeros_like(p["e"])}
        for at in range(0, len(x), SLICE):
            part, ga = x[at : at + SLICE], g_a[at : at + SLICE]
            seen = np.take_along_axis(part[:, None, :], top[at : at + SLICE, :, None] * STRIDE + np.arange(WIDTH), 2)  # chunk, filter, byte
            emb = p["e"][seen].reshape(len(part), FILTERS, WIDTH * EMBED)
            g["w"] += np.matmul(ga.T[:, None, :], emb.transpose(1, 0, 2))[:, 0].T
            back = (ga[:, :, None] * p["w"].T).reshape(-1, EMBED)
            g["e"] += np.stack([np.bincount(seen.reshape(-1), back[:, k], 256) for k in range(EMBED)], 1).astype(a.dtype)
        return g, loss

    def loss(self, docs: list[bytes], y: np.ndarray) -> float:
        p = np.concatenate([self.score(self.responses(c), np.zeros(1, np.int64)) for c in map(chunk_bytes, docs)])
        return float(-np.mean(np.log(np.where(y > 0.5, p, 1 - p))))

    def fit(self, docs: list[bytes], labels: np.ndarray) -> None:
        """docs: whole texts. Every fifth one is set aside to choose the epoch, if there are 50 or more."""
        if not len(docs):
            return
        self.trained = True
        aside = np.arange(len(docs)) % 5 == 4 if len(docs) >= 50 else np.zeros(len(docs), bool)
        learn, check = np.nonzero(~aside)[0], np.nonzero(aside)[0]
        r = np.random.default_rng(SEED)
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(learn) // BATCH)))
        best, best_at, best_p = np.inf, 0, self.p
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + 1e-4
            order = learn[r.permutation(len(learn))]
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                g, _ = self.gradients([chunk_bytes(docs[i]) for i in pick], labels[pick])
                t += 1
                for k, p in list(self.p.items()):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = (p - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            now = self.loss([docs[i] for i in check], labels[check]) if len(check) else -epoch
            if now < best:
                best, best_at, best_p = now, epoch, dict(self.p)
            elif epoch - best_at >= PATIENCE:
                break
        self.p = best_p


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[int, int, bytes]]:
    """At most sample rows of doc_id, quality and deflated whole text, in order of doc_id."""
    key = F.col("doc_id").cast("string")
    ids = labels.where("quality is not null and doc_id is not null").where(F.crc32(key) % 3 != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)  # at most sample rows: small by that bound
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [zlib.compress((t.as_py() or "").encode(), 3) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality").cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "quality", "packed"])

    one = rows.mapInArrow(run, "doc_id long, quality int, packed binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("packed").alias("packed"))
    return sorted((r["doc_id"], r["quality"], bytes(r["packed"])) for r in one.collect())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    rows = training_rows(docs, labels, sample)
    net = Net()
    net.fit([zlib.decompress(packed) for _, _, packed in rows], np.array([float(q) for _, q, _ in rows], np.float32))
    return net


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, net: Net) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted; whole texts."""
    weights, trained = net.p, net.trained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Net()
        model.p, model.trained = weights, trained
        for b in batches:
            ids = b.column(0).to_pylist()
            scores = np.full(len(ids), 0.5)
            pending: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                starts = np.concatenate([[0], np.cumsum([len(c) for _, c in pending])[:-1]])
                scores[[i for i, _ in pending]] = model.score(model.responses(np.concatenate([c for _, c in pending])), starts)
                pending.clear()

            if trained:
                held = 0
                for i, t in enumerate(b.column(1)):
                    c = chunk_bytes((t.as_py() or "").encode())
                    if pending and held + len(c) > AT_ONCE:
                        flush()
                        held = 0
                    pending.append((i, c))
                    held += len(c)
                if pending:
                    flush()
            out = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.bool_()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

"""Language of documents by a bidirectional gated recurrent network over bytes, trained here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpanel.llm.words import SPACE, Words, blocks

UNKNOWN = "und"
HIDDEN = 16
#: Bytes of one sequence; a longer word is read in pieces.
PIECE = 32
#: Training sample: documents of each language, and words of each document (or stretches of ``STRETCH`` bytes of longer words).
DOCS_PER_LANG, WORDS_PER_DOC, STRETCH = 250, 64, 128
EPOCHS, BATCH, RATE = 6, 256, 0.01
_KNOWN_BYTES = 1 << 26
_CHUNK = 2048


def cut(word: bytes) -> list[bytes]:
    """The word with a space at either end, in pieces of at most ``PIECE`` bytes."""
    word = b" " + word + b" "
    return [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


def padded(pieces: list[bytes]) -> np.ndarray:
    """Bytes of the pieces (time, rows), with zeros behind their ends."""
    size = max(map(len, pieces))
    joined = b"".join(p.ljust(size, b"\0") for p in pieces)
    return np.frombuffer(joined, np.uint8).reshape(len(pieces), size).T.copy()


class Direction:
    """One direction of the network; its first position starts from a zero state."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.byte = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.state = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, rows, hidden) of byte rows ``x`` (time, rows). ``keep`` collects what training needs."""
        m = self.hidden
        h = np.zeros((x.shape[1], m), self.state.dtype)
        out = np.empty((*x.shape, m), self.state.dtype)
        # sigmoid(a) = (tanh(a / 2) + 1) / 2, halved once in the weights
        half = np.where(np.arange(3 * m) < 2 * m, 0.5, 1).astype(self.state.dtype)
        byte, state = self.byte * half, self.state * half
        for t in range(len(x)):
            read, past = byte[x[t]], h @ state
            gates = read[:, : 2 * m]
            gates += past[:, : 2 * m]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r, new = gates[:, :m], gates[:, m:], read[:, 2 * m :]
            new += r * past[:, 2 * m :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((h, z, r, new, past[:, 2 * m :]))
            h = np.subtract(h, new, out=out[t])
            h *= z
            h += new
        return out

    def back(self, x: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of (byte, state) from those of the states, by backpropagation through time."""
        m, carry = self.hidden, np.zeros_like(grad[0])
        at_gates, d_state = np.empty((*x.shape, 3 * m), grad.dtype), np.zeros_like(self.state)
        for t in reversed(range(len(x))):
            h, z, r, new, past = kept[t]
            dh = grad[t] + carry
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * past * r * (1 - r)
            at_gates[t] = np.concatenate([d_z, d_r, d_new], 1)
            at_past = np.concatenate([d_z, d_r, d_new * r], 1)
            d_state += h.T @ at_past
            carry = dh * z + at_past @ self.state.T
        flat, rows = x.ravel(), at_gates.reshape(-1, 3 * m)
        order = np.argsort(flat, kind="stable")
        bytes_, first = np.unique(flat[order], return_index=True)
        d_byte = np.zeros_like(self.byte)
        d_byte[bytes_] = np.add.reduceat(rows[order], first, axis=0)
        return d_byte, d_state


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Reverses the first ``lengths`` entries of each column along time."""
    t = np.arange(len(x))[:, None]
    at = np.where(t < lengths, lengths - 1 - t, t)
    return np.take_along_axis(x, at.reshape(*at.shape, *[1] * (x.ndim - 2)), 0)


class Network:
    """Labels every byte of a sequence with a language, reading it from both ends."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.behind = Direction(rng, hidden), Direction(rng, hidden)
        self.weight = rng.normal(0, 0.1, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.state, self.behind.byte, self.behind.state, self.weight, self.bias]

    def log_probabilities(self, x: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None):
        """(time, rows, languages), and the states they come from."""
        a = self.ahead.run(x, keep and keep[0])
        b = _turned(self.behind.run(_turned(x, lengths), keep and keep[1]), lengths)
        states = np.concatenate([a, b], 2)
        logits = states @ self.weight + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), states

    def gradients(self, x: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by every parameter."""
        keep: tuple[list, list] = ([], [])
        logp, states = self.log_probabilities(x, lengths, keep)
        inside = (np.arange(len(x))[:, None] < lengths)[:, :, None]
        target = np.zeros_like(logp)
        np.put_along_axis(target, np.broadcast_to(label[None, :, None], (*x.shape, 1)), 1, 2)
        n = lengths.sum()
        loss = -(logp * target * inside).sum() / n
        d_logits = ((np.exp(logp) - target) * inside / n).astype(states.dtype)
        m = self.ahead.hidden
        d_states = d_logits @ self.weight.T
        d_weight = states.reshape(-1, 2 * m).T @ d_logits.reshape(-1, d_logits.shape[2])
        ahead = self.ahead.back(x, keep[0], d_states[:, :, :m])
        behind = self.behind.back(_turned(x, lengths), keep[1], _turned(d_states[:, :, m:], lengths))
        return float(loss), [*ahead, *behind, d_weight, d_logits.sum((0, 1))]

    def train(self, words: list[bytes], label: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        """Adam over shuffled batches of pieces; returns the mean loss of each epoch."""
        pieces = [(p, k) for w, k in zip(words, label.tolist(), strict=True) for p in cut(w)]
        label = np.array([k for _, k in pieces])
        lengths = np.array([len(p) for p, _ in pieces])
        rng, losses, step = np.random.default_rng(seed), [], 0
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        batches = -(-len(pieces) // BATCH)
        for _ in range(epochs):
            # like lengths share a batch, so little is padded; which pieces meet and the order of batches are random
            order = np.argsort(lengths + rng.random(len(pieces)) * 2, kind="stable")
            total = 0.0
            for b in rng.permutation(batches):
                which = order[b * BATCH : (b + 1) * BATCH]
                loss, grads = self.gradients(padded([pieces[i][0] for i in which]), lengths[which], label[which])
                step += 1
                rate = RATE * (1 - 0.95 * step / (epochs * batches))
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    g = g / max(1.0, norm)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
                total += loss
            losses.append(total / batches)
        return losses

    def piece_sums(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of the probabilities of all positions of each sequence (rows, languages)."""
        a = self.ahead.run(x)
        b = _turned(self.behind.run(_turned(x, lengths)), lengths)
        m = self.ahead.hidden
        logits = (a.reshape(-1, m) @ self.weight[:m] + b.reshape(-1, m) @ self.weight[m:] + self.bias).T
        # languages first: reductions then run over long rows
        odds = np.exp(logits - logits.max(axis=0)).reshape(len(self.langs), *x.shape)
        odds *= (np.arange(len(x))[:, None] < lengths) / odds.sum(axis=0)
        return odds.sum(axis=1).T

    def word_sums(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of a byte array: the sum of its positions' probabilities, and its number of positions."""
        count = end - start + 2
        parts = -(-count // PIECE)
        word = np.repeat(np.arange(len(start)), parts)
        begin = (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
        length = np.minimum(count[word] - begin, PIECE)
        order = np.argsort(length, kind="stable")
        sums = np.empty((len(word), len(self.langs)))
        for lo in range(0, len(order), _CHUNK):
            which = order[lo : lo + _CHUNK]
            w, n = word[which], length[which]
            place = begin[which] + np.arange(n[-1])[:, None]  # 0 and count - 1 are the spaces
            inside = (place > 0) & (place < count[w] - 1)
            x = np.where(inside, data[np.where(inside, start[w] + place - 1, 0)], np.uint8(32))
            sums[which] = self.piece_sums(x, n)
        return np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0) if len(word) else sums, count


class Reader:
    """Languages of blocks of texts. Each distinct word runs through the network once while a task remembers it."""

    def __init__(self, network: Network):
        self.network = network
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, len(self.network.langs)), np.float32)
        self.count = np.zeros(0, np.int64)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean over all positions of each row; zeros for a row without a word."""
        words = Words(data, offsets, SPACE)
        rows = len(offsets) - 1
        if not len(words.start):
            return np.zeros((rows, len(self.network.langs)))
        hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if self.hashes.nbytes + self.sums.nbytes + self.count.nbytes > _KNOWN_BYTES:
            self._forget()
        new = np.flatnonzero(~np.isin(hashes, self.hashes, assume_unique=True))
        sums, count = self.network.word_sums(data, words.start[first[new]], words.end[first[new]])
        every = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(every)
        self.hashes = every[order]
        self.sums = np.concatenate([self.sums, sums.astype(np.float32)])[order]
        self.count = np.concatenate([self.count, count])[order]
        at = np.searchsorted(self.hashes, hashes)[which]
        row = words.row
        total = np.stack([np.bincount(row, self.sums[at, k], rows) for k in range(self.sums.shape[1])], 1)
        return total / np.maximum(np.bincount(row, self.count[at], rows), 1)[:, None]

    def languages(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        names, scores = [], []
        for lo, hi, data, offsets in blocks(texts):
            p = self.probabilities(data, offsets) if self.network.langs else np.zeros((hi - lo, 1))
            letters = [t.as_py() is not None and any(map(str.isalpha, t.as_py())) for t in texts.slice(lo, hi - lo)]
            known = np.array(letters, bool) & bool(self.network.langs)
            best = p.argmax(axis=1)
            names += [self.network.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out(id_col: str = "doc_id") -> Column:
    """Fixed value: the rows kept for measuring are those with crc32(id as text) mod 3 = 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def stretches(word: bytes) -> list[bytes]:
    """The word in pieces of at most ``STRETCH`` bytes that part no character."""
    out, at = [], 0
    while len(word) - at > STRETCH:
        end = at + STRETCH
        while end > at + STRETCH - 4 and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def _sampled(words: int):
    """A random sample of the words of each text, the same in every run. Longer words take part by their stretches, so of
    a script without spaces any part of a text may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, key in zip(batch.column("_text").to_pylist(), batch.column("order").to_pylist(), strict=True):
                found = [piece for word in text.encode().split() for piece in stretches(word)]
                pick = np.random.default_rng(key & 0x7FFFFFFF).permutation(len(found))[:words]
                out.append([found[i] for i in sorted(pick.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array(out, pa.list_(pa.binary()))], ["lang", "order", "words"])

    return run


def fit(
    docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_lang: int = DOCS_PER_LANG, words_per_doc: int = WORDS_PER_DOC, epochs: int = EPOCHS,
) -> Network:
    """A network trained on a bounded sample of the labelled rows for which ``learn`` holds.

    The sample is at most ``docs_per_lang`` documents of each language (those with the least hash of id and text) and
    ``words_per_doc`` random words of each, so it grows with the number of languages only.
    """
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.filter(~held_out(id_col) if learn is None else learn)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"), order.alias("order"))
    counts = rows.groupBy("lang").count().collect()
    names = sorted(r.lang for r in counts)
    if not names:
        return Network([])
    # a hash below the limit lets about twice the wanted number of a language through; the rank keeps the first ones
    shares = [F.lit(x) for r in sorted(counts, key=lambda r: r.lang) for x in (r.lang, min(1.0, 2.0 * docs_per_lang / r["count"]))]
    share = F.try_element_at(F.create_map(*shares), F.col("lang"))
    near = rows.filter(F.pmod("order", F.lit(1 << 20)) <= share * (1 << 20))
    sample = near.mapInArrow(_sampled(words_per_doc), "lang string, order bigint, words array<binary>")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 20)), "order"))
    chosen = sample.withColumn("rank", rank).filter(F.col("rank") <= docs_per_lang).select("lang", "order", "words").collect()
    place = {name: k for k, name in enumerate(names)}
    words, label = [], []
    for r in sorted(chosen, key=lambda r: (r.lang, r.order)):
        words += [bytes(w) for w in r.words]
        label += [place[r.lang]] * len(r.words)
    network = Network(names)
    if words:
        network.train(words, np.array(label), epochs)
    return network


def languages(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` per row of ``docs``.

    The network labels every byte of every word of the whole text; the document's probabilities are the mean over all
    positions, ``lang_pred`` the largest and ``score`` its value. Words (runs of anything but ASCII white space) are
    read one by one, from a zero state at either end, so a task runs each distinct word once and weighs it by its
    number.

    Texts that are null or have no letter are ``und`` with score 0, as is everything if no row was labelled. An id that
    is null is not held out, but nothing is learned from it. Ids may repeat; other columns are ignored; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            names, scores = reader.languages(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["_id", "held_out", "lang_pred", "score"]
            )

    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(run, f"_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)


def keep_known(docs: DataFrame, network: Network, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or whose score is below ``least``; all columns stay."""
    shared, place = docs.sparkSession.sparkContext.broadcast(network), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            names, scores = reader.languages(batch.column(place))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores.tolist(), strict=True)]))

    kept: Callable = run
    return docs.mapInArrow(kept, docs.schema)

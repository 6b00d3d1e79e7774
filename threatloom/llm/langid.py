"""Language identification with a bidirectional gated recurrent network over bytes, trained and run in numpy."""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threatloom.llm.common import map_arrow, text_bytes
from threatloom.session import cut_lineage

#: Documents per language that the network learns from, and distinct words of them: bounded samples.
TRAIN_DOCS, TRAIN_WORDS = 300, 6_000
#: Most ids of sampled documents that are broadcast to find their texts; more (over 300 languages) are joined by shuffle.
FEW_CHOSEN = 100_000
HIDDEN, EMBED, ROUNDS, BATCH, RATE = 24, 12, 900, 192, 0.01
#: Longest byte sequence of the network; longer words are cut.
SPAN = 32
EDGE = 256  # symbol before and after a word
#: Words remembered in each of two generations.
REMEMBERED = 400_000
_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_AROUND = bytes(c for c in range(128) if not chr(c).isalpha())
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded symbol rows of the words' spans, their lengths (edges included), and each row's word."""
    parts = [(k, w[s: s + SPAN]) for k, w in enumerate(words) for s in range(0, max(1, len(w)), SPAN)]
    lengths = np.array([len(p) + 2 for _, p in parts], np.int64)
    rows = np.full((len(parts), int(lengths.max(initial=2))), EDGE, np.int64)
    flat = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
    inside = np.arange(rows.shape[1])
    rows[(inside >= 1) & (inside[None, :] < (lengths - 1)[:, None])] = flat
    return rows, lengths, np.array([k for k, _ in parts], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteTagger:
    """Embedding, one gated recurrent layer in each direction, and a softmax over languages at every position."""

    def __init__(self, languages: list[str], seed: int = 5):
        draw = np.random.default_rng(seed)
        self.languages = languages

        def matrix(*shape):
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {"embed": matrix(EDGE + 1, EMBED), "out": matrix(2 * HIDDEN, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for side in "fb":
            self.w |= {f"in_{side}": matrix(EMBED, 3 * HIDDEN), f"gate_{side}": matrix(HIDDEN, 2 * HIDDEN),
                       f"new_{side}": matrix(HIDDEN, HIDDEN), f"b_{side}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, embedded: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States after each position, and what the way back needs. A masked position keeps the state."""
        n, steps, _ = embedded.shape
        given = embedded @ self.w[f"in_{side}"] + self.w[f"b_{side}"]
        state, states, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = _sigmoid(given[:, t, : 2 * HIDDEN] + state @ self.w[f"gate_{side}"])
            reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
            fresh = np.tanh(given[:, t, 2 * HIDDEN:] + (reset * state) @ self.w[f"new_{side}"])
            m = mask[:, t, None]
            after = np.where(m, update * state + (1 - update) * fresh, state)
            kept.append((t, state, reset, update, fresh, m))
            state = after
            states[:, t] = state
        return states, kept

    def log_probabilities(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(row, position, language)."""
        mask = np.arange(rows.shape[1])[None, :] < lengths[:, None]
        embedded = self.w["embed"][rows]
        both = np.concatenate([self._run(embedded, mask, "f")[0], self._run(embedded, mask, "b")[0]], axis=2)
        logits = both @ self.w["out"] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    def gradients(self, rows: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions, and its gradient by backpropagation through time."""
        mask = np.arange(rows.shape[1])[None, :] < lengths[:, None]
        embedded = self.w["embed"][rows]
        (ahead, kept_f), (behind, kept_b) = self._run(embedded, mask, "f"), self._run(embedded, mask, "b")
        both = np.concatenate([ahead, behind], axis=2)
        logits = both @ self.w["out"] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(axis=2, keepdims=True)
        count = mask.sum()
        loss = -np.log(np.take_along_axis(share, labels[:, None, None], axis=2)[..., 0] + 1e-12)[mask].sum() / count
        back = share.copy()
        np.put_along_axis(back, np.broadcast_to(labels[:, None, None], (*back.shape[:2], 1)).copy(), np.take_along_axis(back, labels[:, None, None], axis=2) - 1, axis=2)
        back *= mask[..., None] / np.float32(count)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"], g["bias"] = np.einsum("nth,ntl->hl", both, back), back.sum(axis=(0, 1))
        to_states = back @ self.w["out"].T
        to_embedded = np.zeros_like(embedded)
        for side, kept, from_out in (("f", kept_f, to_states[..., :HIDDEN]), ("b", kept_b, to_states[..., HIDDEN:])):
            gate, new, into = self.w[f"gate_{side}"], self.w[f"new_{side}"], self.w[f"in_{side}"]
            carry = np.zeros((len(rows), HIDDEN), np.float32)
            for t, state, reset, update, fresh, m in reversed(kept):
                full = carry + from_out[:, t]
                d = full * m
                d_new = d * (1 - update) * (1 - fresh * fresh)
                through = d_new @ new.T
                d_gates = np.concatenate([through * state * reset * (1 - reset), d * (state - fresh) * update * (1 - update)], axis=1)
                g[f"new_{side}"] += (reset * state).T @ d_new
                g[f"gate_{side}"] += state.T @ d_gates
                d_given = np.concatenate([d_gates, d_new], axis=1)
                g[f"in_{side}"] += embedded[:, t].T @ d_given
                g[f"b_{side}"] += d_given.sum(axis=0)
                to_embedded[:, t] += d_given @ into.T
                carry = d * update + through * reset + d_gates @ gate.T + full * ~m
        np.add.at(g["embed"], rows, to_embedded)
        return float(loss), g

    def train(self, words: list[bytes], labels: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS, seed: int = 6) -> "ByteTagger":
        """Adam over batches drawn by weight."""
        draw = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        chance = weights / weights.sum()
        picks = draw.choice(len(words), (rounds, BATCH), p=chance)
        for n in range(rounds):
            chosen = [words[k][:SPAN] for k in picks[n]]
            rows, lengths, _ = sequences(chosen)
            _, g = self.gradients(rows, lengths, labels[picks[n]])
            rate = RATE * (1 - n / rounds) + 1e-4
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                self.w[k] -= rate * (first[k] / (1 - 0.9 ** (n + 1))) / (np.sqrt(second[k] / (1 - 0.999 ** (n + 1))) + 1e-8)
        return self

    def _states(self, rows: np.ndarray, side: str, table: np.ndarray) -> np.ndarray:
        """The states of ``_run`` for rows of one length, position first; ``table`` holds each symbol's input to the gates."""
        n, steps = rows.shape
        gate, new = self.w[f"gate_{side}"], self.w[f"new_{side}"]
        state, states = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            given = table[rows[:, t]]
            gates = state @ gate
            gates += given[:, : 2 * HIDDEN]
            gates *= np.float32(0.5)
            np.tanh(gates, out=gates)
            gates += np.float32(1)
            gates *= np.float32(0.5)
            fresh = (gates[:, :HIDDEN] * state) @ new
            fresh += given[:, 2 * HIDDEN:]
            np.tanh(fresh, out=fresh)
            state = fresh + gates[:, HIDDEN:] * (state - fresh)
            states[t] = state
        return states

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Sum over each word's positions of the language log probabilities; one row a word. The same as ``log_probabilities`` gives, by length."""
        out = np.zeros((len(words), len(self.languages)))
        tables = {side: self.w["embed"] @ self.w[f"in_{side}"] + self.w[f"b_{side}"] for side in "fb"}
        top, bottom = self.w["out"][:HIDDEN], self.w["out"][HIDDEN:]
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        for k, word in enumerate(words):
            for s in range(0, max(1, len(word)), SPAN):
                part = word[s: s + SPAN]
                owners, parts = by_length.setdefault(len(part), ([], []))
                owners.append(k)
                parts.append(part)
        for length, (owners, parts) in by_length.items():
            owner = np.array(owners)
            rows = np.full((len(parts), length + 2), EDGE, np.int64)
            rows[:, 1:-1] = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), length)
            for s in range(0, len(rows), 4096):
                own = rows[s: s + 4096]
                logits = self._states(own, "f", tables["f"]) @ top + self._states(own, "b", tables["b"]) @ bottom + self.w["bias"]
                flat = np.ascontiguousarray(logits.transpose(2, 0, 1))  # language, position, row
                flat -= flat.max(axis=0)
                flat -= np.log(np.exp(flat).sum(axis=0))
                sums = flat.sum(axis=1).T
                if length < SPAN:
                    out[owner[s: s + 4096]] += sums
                else:
                    np.add.at(out, owner[s: s + 4096], sums)
        return out


def cores(text: bytes) -> list[bytes]:
    """Words between ASCII white space in lower case, without the ASCII marks and digits around them; those with nothing left are gone."""
    return [c for w in text.lower().split() if (c := w.strip(_AROUND))]


class _Known:
    """Positions and language shares of words, in two generations, so that words in use stay known; one per Python worker and model."""

    def __init__(self, tagger: ByteTagger):
        self.tagger, self.young, self.old = tagger, ({}, None), ({}, None)

    def learn(self, words: set[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
        """Numbers and values (share of each language times positions) of at least ``words``."""
        number, values = self.young
        if len(number) + len(words) > REMEMBERED:
            self.old, (number, values) = self.young, ({}, None)
        new = list(words - number.keys())
        if new:
            before = self.old[0]
            again = [w for w in new if w in before]
            other = [w for w in new if w not in before]
            sums = self.tagger.evidence(other)
            share = np.exp(sums - sums.max(axis=1, keepdims=True)) if len(sums) else sums
            fresh = share / share.sum(axis=1, keepdims=True) * np.array([len(w) for w in other], float)[:, None] if len(sums) else share
            parts = [values] if values is not None else []
            parts += [self.old[1][[before[w] for w in again]]] if again else []
            number.update(zip(again + other, range(len(number), len(number) + len(new))))
            values = np.concatenate([*parts, fresh])
        self.young = number, values
        return self.young


_WORKER: dict[bytes, _Known] = {}


def _train_rows(docs: DataFrame) -> DataFrame:
    """A bounded sample: of each learned language, the TRAIN_DOCS documents that come first by a hash of their id."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", text_bytes())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang", F.row_number().over(order).alias("nth")).where(F.col("nth") <= TRAIN_DOCS).select("doc_id", "lang")
    chosen = cut_lineage(chosen)
    return labelled.join(F.broadcast(chosen) if chosen.count() <= FEW_CHOSEN else chosen, ["doc_id", "lang"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words)
    languages = sorted(counts)
    if not languages:
        return
    words, labels, weights = [], [], []
    for k, lang in enumerate(languages):
        most = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))
        # Frequent words and as many rare ones, spread over the rest.
        own = most[: TRAIN_WORDS // 2] + most[TRAIN_WORDS // 2:: max(1, (len(most) - TRAIN_WORDS // 2) // (TRAIN_WORDS // 2) + 1)] if len(most) > TRAIN_WORDS else most
        own_weights = np.sqrt(np.array([n for _, n in own], float)) if own else np.zeros(0)
        words += [w for w, _ in own]
        labels += [k] * len(own)
        weights.append(own_weights / max(own_weights.sum(), 1e-9))
    model = ByteTagger(languages)
    if words:
        model.train(words, np.array(labels), np.concatenate(weights))
    out = io.BytesIO()
    np.savez(out, languages=np.array(languages), **model.w)
    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cores(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], ["lang", "words"])


def fit(docs: DataFrame) -> ByteTagger | None:
    """Trained in one task on the bounded sample; only the weights come back. None if nothing is labelled."""
    sample = map_arrow(_train_rows(docs).orderBy("lang", "doc_id").select("lang", "text"), _words, "lang string, words array<binary>")
    found = map_arrow(sample.coalesce(1), _fit, "model binary").collect()
    if not found:
        return None
    saved = np.load(io.BytesIO(found[0]["model"]))
    model = ByteTagger([str(x) for x in saved["languages"]])
    model.w = {k: saved[k] for k in saved.files if k != "languages"}
    return model


def predicted(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``, from the whole text alone.

    The network reads each word between ASCII white space (in lower case, without the marks and digits around it) with an edge before
    and after and labels every byte; a word's labels depend on nothing else, so those of a word met before are remembered. A
    document's probability of a language is the mean of the words' own, a word weighing as many positions as it has. A null text or
    one without letters is ``und`` with score zero, as is everything where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, known = shared.value, None
        if tagger:
            name = tagger.w["out"].tobytes()
            if name not in _WORKER:
                _WORKER.clear()
                _WORKER[name] = _Known(tagger)
            known = _WORKER[name]
        for batch in batches:
            names, scores = [], []
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (size < 4 << 20 or end == at):
                    size += len(texts[end])
                    end += 1
                split = [cores(t) for t in texts[at:end]]
                number, values = known.learn(set().union(*split)) if known else ({}, None)
                for text, own in zip(texts[at:end], split):
                    if known and own and _has_letter(text):
                        pooled = values[[number[w] for w in own]].sum(axis=0)
                        best = int(pooled.argmax())
                        names.append(tagger.languages[best])
                        scores.append(float(pooled[best] / pooled.sum()))
                    else:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select(text_bytes(), "doc_id", held_out().alias("held_out")), rows, "doc_id long, held_out boolean, lang_pred string, score double")


def _has_letter(text: bytes) -> bool:
    """Whether any character is a letter; an ASCII one is found without decoding."""
    return len(text) != len(text.translate(None, _LETTERS)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def identified(docs: DataFrame) -> DataFrame:
    return predicted(docs, fit(docs))

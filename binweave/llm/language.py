"""Language identification by segmentation-marginalised unigrams.

Pieces are the byte strings of a fixed public vocabulary, of any length.  Each language has a
probability per piece; the probability of a word under a language is the sum, over all ways to cut
the word into pieces, of the product of their probabilities, found by a forward pass over the word.
A text's log likelihood is the sum over its words; the prediction is the most likely language, the
first by name if several are equally likely.

A word is lower-cased (A-Z) and gets a space in front, as in the vocabulary; every word is scored
whole, however long.  Probabilities are fitted by expectation maximisation over the same
segmentations; only there, words of more than ``LONGEST`` bytes are learned from in parts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binweave.llm.quality import is_held_out
from binweave.llm.registry import query, table
from binweave.llm.tokens import vocabulary_path
from binweave.llm.words import CHUNK_BYTES, Words, mix, row_chunks, split

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONGEST = 41  # bytes of a word, with its space, that is scored in a dense table
TRAIN_ROWS = 600  # documents per language the probabilities are fitted on
ROUNDS = 4
SMOOTHING = 0.5  # added to each piece's expected count
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"

_SLOT_BITS = 20
_SHORT = 8  # bytes of a piece that fit in one number
_LONG_WORDS, _STRETCH = 512, 256  # long words scored together, and bytes of each at a time
_MOST_SCALE = 1e7  # to the power of ``LONGEST`` still a double


class Pieces:
    """The vocabulary's byte strings: short ones found by number from eight bytes packed in a word,
    longer ones by a walk from their first eight bytes on."""

    def __init__(self, name: str):
        strings = set()
        with open(vocabulary_path(name), "rb") as lines:
            for line in lines:
                piece = base64.b64decode(line.split()[0]) if line.strip() else b""
                inner = piece[1:] if piece[:1] == b" " else piece
                if piece and not any(b in inner for b in b" \t\n\v\f\r"):
                    strings.add(piece.lower())
        strings |= {bytes([b]) for b in range(256)}
        self.strings = sorted(strings)
        self.count = len(self.strings)
        self.sizes = np.array([len(s) for s in self.strings])
        self.reach = int(self.sizes.max())
        self._table([k for k in range(self.count) if self.sizes[k] <= _SHORT])
        self._walks([k for k in range(self.count) if self.sizes[k] > _SHORT])

    def _table(self, short: list[int]) -> None:
        keys = np.array([int.from_bytes(self.strings[k].ljust(8, b"\0"), "little") for k in short], np.uint64)
        lengths = self.sizes[short].astype(np.uint64)
        # A table of slots, four times as long as needed; pieces that share a slot go to the next free one.
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.lengths = np.zeros(1 << _SLOT_BITS, np.uint8)
        self.numbers = np.full(1 << _SLOT_BITS, -1, np.int32)
        slots = self._slot(keys, lengths)
        self.probes = 1
        for at, number in enumerate(short):
            slot, probes = int(slots[at]), 1
            while self.numbers[slot] >= 0:
                slot, probes = (slot + 1) & ((1 << _SLOT_BITS) - 1), probes + 1
            self.keys[slot], self.lengths[slot], self.numbers[slot] = keys[at], lengths[at], number
            self.probes = max(self.probes, probes)

    def _walks(self, longer: list[int]) -> None:
        nodes: dict[bytes, int] = {}
        for k in longer:
            for size in range(_SHORT, len(self.strings[k]) + 1):
                nodes.setdefault(self.strings[k][:size], len(nodes))
        self.piece_at = np.full(len(nodes), -1, np.int32)
        for k in longer:
            self.piece_at[nodes[self.strings[k]]] = k
        heads = sorted((int.from_bytes(s, "little"), n) for s, n in nodes.items() if len(s) == _SHORT)
        steps = sorted((nodes[s[:-1]] << 8 | s[-1], n) for s, n in nodes.items() if len(s) > _SHORT)
        self.head_keys, self.heads = np.array([k for k, _ in heads], np.uint64), np.array([n for _, n in heads], np.int64)
        self.step_keys, self.steps = np.array([k for k, _ in steps], np.int64), np.array([n for _, n in steps], np.int64)

    @staticmethod
    def _look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[place] == keys, values[place], -1)

    def enter(self, keys: np.ndarray) -> np.ndarray:
        """Node reached by eight bytes, or -1."""
        return self._look_up(keys, self.head_keys, self.heads)

    def step(self, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Node reached from each node by one more byte, or -1."""
        return self._look_up(nodes << 8 | values, self.step_keys, self.steps)

    @staticmethod
    def _slot(keys: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (mix(keys ^ (np.asarray(lengths, np.uint64) << np.uint64(57))) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Number of each string of ``length`` bytes, at most eight, or -1."""
        slot = self._slot(keys, length)
        found = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            at = slot[open_]
            hit = (self.keys[at] == keys[open_]) & (self.lengths[at] == length)
            found[open_[hit]] = self.numbers[at[hit]]
            open_ = open_[~hit & (self.numbers[at] >= 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOT_BITS) - 1)
        return found


@cache
def pieces(name: str = VOCABULARY) -> Pieces:
    return Pieces(name)


def distinct_words(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """All words, the spans of the distinct ones, and the distinct one of each occurrence."""
    words = split(column, lower=True)
    _, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    return words, words.starts[at], words.ends[at], inverse


def word_bytes(data: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray | int, width: int) -> np.ndarray:
    """Bytes ``begin`` to ``begin + width - 1`` of each word behind its space; zeros beyond its end."""
    place = np.broadcast_to(np.asarray(begin).reshape(-1, 1) + np.arange(width), (len(low), width))
    source = low[:, None] + place - 1
    out = np.where(source < high[:, None], data[np.clip(source, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
    out[(out >= 0x41) & (out <= 0x5A)] += 32
    out[place == 0] = 0x20
    return out


def matches(units: np.ndarray, lengths: np.ndarray, vocabulary: Pieces, after: int = 0) -> tuple[np.ndarray, ...]:
    """Every piece that ends in a unit (a row of bytes) behind byte ``after``: ends, sizes, units, pieces."""
    n, width = units.shape
    padded = np.zeros((n, width + _SHORT), np.uint8)
    padded[:, :width] = units
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, _SHORT, axis=1)[:, :width]).view(np.uint64)[..., 0]
    unit, start = np.nonzero(np.arange(width) < lengths[:, None])
    keys, left = eight[unit, start], lengths[unit] - start
    parts = []

    def add(at: np.ndarray, size: int, number: np.ndarray) -> None:
        hit = (number >= 0) & (start[at] + size > after)
        at = at[hit]
        parts.append((start[at] + size, np.full(len(at), size), unit[at], number[hit]))

    for size in range(1, _SHORT + 1):
        at = np.flatnonzero((left >= size) & (start + size > after))
        add(at, size, vocabulary.find(keys[at] & np.uint64((1 << (8 * size)) - 1), size))
    at = np.flatnonzero(left > _SHORT)
    node = vocabulary.enter(keys[at])
    for size in range(_SHORT + 1, vocabulary.reach + 1):
        onward = (node >= 0) & (left[at] >= size)
        at, node = at[onward], node[onward]
        if not len(at):
            break
        node = vocabulary.step(node, units[unit[at], start[at] + size - 1])
        add(at, size, np.where(node >= 0, vocabulary.piece_at[node], -1))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _matches(units: np.ndarray, lengths: np.ndarray, vocabulary: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same by end and size: ``(end, size, unit numbers, piece numbers)``, each unit at most once in a row."""
    end, size, unit, piece = matches(units, lengths, vocabulary)
    both = end * (vocabulary.reach + 1) + size
    order = np.argsort(both, kind="stable")
    both, unit, piece = both[order], unit[order], piece[order]
    cuts = np.flatnonzero(np.diff(both, prepend=-1, append=-1)) if len(both) else np.zeros(1, int)
    return [(*divmod(int(both[a]), vocabulary.reach + 1), unit[a:b], piece[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _scaled(log_p: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, float]:
    """Probabilities times a factor per byte, which keeps sums over ``LONGEST`` bytes in the range of doubles,
    and the factor's logarithm."""
    factor = min(-float(log_p.min(initial=0)) / 2, float(np.log(_MOST_SCALE)))
    return np.exp(log_p + vocabulary.sizes[:, None] * factor), factor


def forward(matches, n: int, longest: int, probabilities: np.ndarray) -> np.ndarray:
    """Sums over all segmentations up to each end: ``(ends + 1, n, languages)``."""
    alpha = np.zeros((longest + 1, n, probabilities.shape[1]))
    alpha[0] = 1
    for end, size, unit, piece in matches:
        alpha[end, unit] += alpha[end - size, unit] * probabilities[piece]
    return alpha


def log_likelihoods(units: np.ndarray, lengths: np.ndarray, log_p: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Natural log probability of each unit of at most ``LONGEST`` bytes under each language."""
    out = np.zeros((len(units), log_p.shape[1]))
    probabilities, factor = _scaled(log_p, vocabulary)
    order = np.argsort(lengths, kind="stable")
    # Units of like length go together, so that short ones don't wait for long ones.
    block = max(64, 65_536 // max(1, log_p.shape[1]))
    for low in range(0, len(order), block):
        some = order[low : low + block]
        longest = int(lengths[some].max())
        found = _matches(units[some][:, :longest], lengths[some], vocabulary)
        alpha = forward(found, len(some), longest, probabilities)
        out[some] = np.log(alpha[lengths[some], np.arange(len(some))]) - lengths[some][:, None] * factor
    return out


def long_log_likelihoods(data: np.ndarray, low: np.ndarray, high: np.ndarray, log_p: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """The same for words of any length, given as byte spans.

    The forward pass works in logarithms and a stretch of bytes at a time; only the sums that a
    piece can still start from are kept, so memory does not grow with a word's length.
    """
    out = np.zeros((len(low), log_p.shape[1]))
    order = np.argsort(high - low, kind="stable")
    for first in range(0, len(order), _LONG_WORDS):
        some = order[first : first + _LONG_WORDS]
        out[some] = _long_forward(data, low[some], high[some], log_p, vocabulary)
    return out


def _long_forward(data: np.ndarray, low: np.ndarray, high: np.ndarray, log_p: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    lengths = high - low + 1
    around = vocabulary.reach + 1
    sums = np.zeros((around, len(low), log_p.shape[1]))  # by end modulo ``around``
    out = np.zeros((len(low), log_p.shape[1]))
    for done in range(0, int(lengths.max()), _STRETCH):
        live = np.flatnonzero(lengths > done)
        base = max(0, done - vocabulary.reach)
        stop = min(done + _STRETCH, int(lengths.max()))
        units = word_bytes(data, low[live], high[live], base, stop - base)
        end, size, unit, piece = matches(units, np.minimum(lengths[live] - base, stop - base), vocabulary, done - base)
        order = np.lexsort((unit, end))
        end, size, word, piece = end[order] + base, size[order], live[unit[order]], piece[order]
        heads = np.flatnonzero((np.diff(end, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        groups = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(end)))
        cuts = np.searchsorted(end, np.arange(done + 1, stop + 2))
        for now in range(done + 1, stop + 1):
            a, b = cuts[now - done - 1], cuts[now - done]
            group = groups[a:b] - groups[a]
            head = heads[groups[a] : groups[b - 1] + 1]
            terms = sums[(now - size[a:b]) % around, word[a:b]] + log_p[piece[a:b]]
            top = np.maximum.reduceat(terms, head - a, axis=0)
            here = word[head]
            sums[now % around, here] = top + np.log(np.add.reduceat(np.exp(terms - top[group]), head - a, axis=0))
            last = here[lengths[here] == now]
            out[last] = sums[now % around, last]
    return out


def word_log_likelihoods(column: pa.Array, log_p: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each word under each language, and the row offsets into the words."""
    words, low, high, inverse = distinct_words(column)
    out = np.zeros((len(low), log_p.shape[1]))
    lengths = high - low + 1
    short, long = np.flatnonzero(lengths <= LONGEST), np.flatnonzero(lengths > LONGEST)
    out[short] = log_likelihoods(word_bytes(words.data, low[short], high[short], 0, LONGEST), lengths[short], log_p, vocabulary)
    out[long] = long_log_likelihoods(words.data, low[long], high[long], log_p, vocabulary)
    return out[inverse], words.first


def fit_language(column: pa.Array, vocabulary: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Log probability per piece after ``rounds`` of expectation maximisation on the texts."""
    matched, weights = [], []
    for first, last in row_chunks(column):
        words, low, high, inverse = distinct_words(column.slice(first, last - first))
        times = np.bincount(inverse, minlength=len(low)).astype(float)
        parts = -(-(high - low + 1) // LONGEST)
        number = np.repeat(np.arange(len(low)), parts)
        begin = (np.arange(len(number)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
        lengths = np.minimum((high - low + 1)[number] - begin, LONGEST)
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), 16_384):
            some = order[at : at + 16_384]
            longest, which = int(lengths[some].max()), number[some]
            units = word_bytes(words.data, low[which], high[which], begin[some], longest)
            matched.append((_matches(units, lengths[some], vocabulary), lengths[some], longest))
            weights.append(times[which])
    log_p = np.full((vocabulary.count, 1), -np.log(vocabulary.count))
    for _ in range(rounds):
        p, _ = _scaled(log_p, vocabulary)
        expected = np.zeros(vocabulary.count)
        for (found, lengths, longest), count in zip(matched, weights, strict=True):
            alpha = forward(found, len(lengths), longest, p)[:, :, 0]
            beta = np.zeros((longest + 1, len(lengths)))
            every = np.arange(len(lengths))
            beta[lengths, every] = 1
            total = count / alpha[lengths, every]
            for end, size, unit, piece in reversed(found):
                onward = beta[end, unit] * p[piece, 0]
                share = alpha[end - size, unit] * onward * total[unit]
                expected += np.bincount(piece, weights=share, minlength=vocabulary.count)
                beta[end - size, unit] += onward
        log_p = np.log((expected + SMOOTHING) / (expected.sum() + SMOOTHING * vocabulary.count))[:, None]
    return log_p[:, 0]


def train(docs: DataFrame, rows: int = TRAIN_ROWS, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and their piece log probabilities (pieces x languages).

    Learns from at most ``rows`` documents of each language, the least by a hash of doc_id, among
    those not held out with a language and a text; each language is fitted in a task of its own.
    """
    usable = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    ids = usable.select("doc_id", "lang")
    # Only ids whose hash is low enough for about three times ``rows`` are ranked at all.
    sizes = ids.groupBy("lang").agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(1 << 40)
    # One small row per language, of which there must be few: the model holds a column for each.
    low = ids.join(F.broadcast(sizes), "lang").filter(place < F.lit(3.0 * rows) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    sample = F.broadcast(  # at most ``rows`` ids per language
        low.withColumn("_rank", rank).filter(F.col("_rank") <= rows).select("doc_id").distinct()
    )
    chosen = usable.select("doc_id", "lang", "text").join(sample, "doc_id")

    def fit(texts: pa.Table) -> pa.Table:
        column = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])["text"].cast(pa.large_string()).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        log_p = fit_language(column, pieces(vocabulary)).astype(np.float32)
        return pa.table({"lang": [texts["lang"][0].as_py()], "log_p": pa.array([log_p.tobytes()], pa.binary())})

    found = chosen.groupBy("lang").applyInArrow(fit, "lang string, log_p binary").orderBy("lang").collect()
    if not found:
        return [], np.zeros((pieces(vocabulary).count, 0))
    return [r["lang"] for r in found], np.stack([np.frombuffer(r["log_p"], np.float32) for r in found], axis=1).astype(float)


def predict(docs: DataFrame, languages: list[str], log_p: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the predicted language's share of the likelihood.

    A NULL text and one without a letter get ``und`` and 0, as do all if no language was learned; of
    equally likely languages the first by name is predicted.  Rows that repeat each other get the
    same, an empty table stays empty, and columns of ``docs`` that bear the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((languages, log_p))  # vocabulary x languages
    kept = docs.select([c for c in docs.columns if c not in ("lang_pred", "score", "__letter")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        tool = pieces(vocabulary)
        for batch in batches:
            texts, letter = batch.column("text"), batch.column("__letter").to_numpy(zero_copy_only=False)
            best, share = np.zeros(len(texts), int), np.zeros(len(texts))
            # Memory follows words x languages, so many languages mean shorter chunks.
            most = CHUNK_BYTES * 4 // max(4, len(names))
            for low, high in row_chunks(texts, most) if names else ():
                per_word, first = word_log_likelihoods(texts.slice(low, high - low), weights, tool)
                sums = np.concatenate([np.zeros((1, len(names))), np.cumsum(per_word, axis=0)])
                total = sums[first[1:]] - sums[first[:-1]]
                total -= total.max(axis=1, keepdims=True)
                odds = np.exp(total)
                best[low:high] = odds.argmax(axis=1)
                share[low:high] = 1 / odds.sum(axis=1)
            known = letter & bool(names)
            label = np.where(known, np.array([*names, UNKNOWN], object)[best], UNKNOWN)
            fields = [n for n in batch.schema.names if n != "__letter"]
            arrays = [batch.column(n) for n in fields] + [pa.array(label, pa.string()), pa.array(np.where(known, share, 0.0))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*fields, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    letter = F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False))
    return kept.withColumn("__letter", letter).mapInArrow(run, f"{fields}, lang_pred string, score double")


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    languages, log_p = train(docs)
    return predict(docs.select("doc_id", "text"), languages, log_p).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )

"""Scoring of texts by a causal self-attention model over subword ids, beside a word count baseline.

The corpus gives the counts: words and subwords of all training documents, counted
on Spark.  They fix which subwords have an output of their own, where the output
biases start, and the shares of the subwords that have none.  The network (one
attention layer, one hidden layer, a softmax of two levels) is trained in numpy: it
starts from a bounded number of windows, then learns from every window of every
training document, in the tasks that read them, whose states are averaged between
rounds.  Texts are split and encoded once, into a written table of ids that training
and scoring read.  In use a document's subwords, its end included, are
read in windows of ``WINDOW`` places that begin every ``STEP`` places; the masked
attention of many windows is computed at once, and a window scores its last
``STEP`` places, so each subword is scored once and sees at least
``WINDOW - STEP`` places before it.  Places before a text's start hold a mark of
their own.  The model is a distribution over all subwords: its probabilities sum to 1.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import documents, map_arrow, materialise, prepare

#: Ranks of a public byte-level BPE vocabulary, read by the driver and broadcast.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Longer words are encoded in pieces of so many characters.
PIECE = 64
#: Places of a window, and places between the starts of two.
WINDOW, STEP = 32, 28
#: Vector length, hidden units, classes and subwords in a class, subwords with an input vector of their own.
DIM, HIDDEN, CLASSES, MEMBERS, INPUTS = 16, 32, 32, 16, 4096
SLOTS = CLASSES * MEMBERS
#: Training starts from at most so many windows, ``OF_A_TEXT`` of a document, or more where there are too few documents for that.
TRAIN_WINDOWS, OF_A_TEXT = 48_000, 4
STEPS, BATCH, RATE, SEED, LOOK, PATIENCE = 3000, 128, 0.02, 5, 100, 3
#: Then all training documents are dealt to so many rounds, of falling rates from this one on.
ROUNDS, ROUND_RATE = 4, 0.004
#: Input vectors in a row of what the tasks learned.
VECTORS_A_ROW = 512
#: A word with at least 1 / ``FREQUENT`` of the training tokens, of at most ``SHORT`` bytes, has its count broadcast (so at most ``FREQUENT`` words).
FREQUENT, SHORT = 1 << 19, 64
#: Words kept at once while counting, remembered encodings, and bytes of texts from which on no further batch is encoded with them.
HELD, CACHE, TEXT_AT_ONCE = 3_000_000, 200_000, 1 << 22
#: Windows computed at once, windows whose outputs are, and subwords from which on no further text joins a batch.
WINDOWS_AT_ONCE, OUTPUTS_AT_ONCE, IDS_AT_ONCE = 64, 256, 1 << 14
#: Attention scores and logits are held within this, up and down, so that no exponential over- or underflows.
_MOST = np.float32(60)
#: Added to the count of every subword without an output of its own.
TAIL = 0.5


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z): runs without U+0020 and U+0009 to U+000D."""
    return (text or b"").lower().split()


def all_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, as ``words_of`` gives them, and how many each text has."""
    texts = pc.fill_null(texts, b"")
    # the bytes as they are: strings are not checked to be UTF-8
    texts = pa.StringArray.from_buffers(len(texts), texts.buffers()[1], texts.buffers()[2], offset=texts.offset)
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, number = found.flatten(), pc.list_value_length(found).to_numpy()
    there = pc.binary_length(words).to_numpy() > 0                       # a space at either end leaves an empty word
    if not there.all():
        of = np.repeat(np.arange(len(number)), number)
        words, number = words.filter(pa.array(there)), np.bincount(of[there], minlength=len(number))
    return words.cast(pa.binary()), number.astype(np.int64)


def held_out(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 10 is 0; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 10 == 0


class Subwords:
    """Encodes words by a byte-level vocabulary; the ids after its own are the end of a text and the place before its start."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.end = max(table.values()) + 1
        self.start, self.size = self.end + 1, self.end + 1    # the start is never predicted
        self._encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+",
                                         mergeable_ranks=table, special_tokens={}).encode_ordinary
        # a word is encoded with a space before it and has none within
        self._encode_words = tiktoken.Encoding("spaced", pat_str=r" [^ ]*", mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._first = np.zeros(self.size, bool)
        self._first[[i for t, i in table.items() if t[:1] == b" "]] = True
        self._known: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= CACHE:
                self._known.clear()
            t = " " + word.decode("utf-8", "replace")
            found = tuple(self._encode(t) if len(t) <= PIECE else [
                i for k in range(0, len(t), PIECE) for i in self._encode(t[k:k + PIECE])])
            if len(word) <= SHORT:
                self._known[word] = found
        return found

    def of_words(self, words: list[bytes], out: list[int] | None = None) -> list[int]:
        """The words' ids in a row, then the end; added to ``out`` if given."""
        out = [] if out is None else out
        found = list(map(self._known.get, words))
        if None in found:
            found = [self.of_word(w) if ids is None else ids for w, ids in zip(words, found)]
        out.extend(chain.from_iterable(found))
        out.append(self.end)
        return out

    def of_different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words in a row, and how many each has: all words of at most ``SHORT`` bytes are encoded in one call."""
        short = pc.binary_length(words).to_numpy() <= SHORT
        some = words if short.all() else words.filter(pa.array(short))
        spaced = b" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), b" ")[0].as_py()
        ids = np.array(self._encode_words(spaced.decode("utf-8", "replace")) if len(some) else [], np.int64)
        first = np.flatnonzero(self._first[ids])
        length = np.zeros(len(words), np.int64)
        length[short] = np.diff(first, append=len(ids))
        if short.all():
            return ids, length
        far = {i: np.array(self.of_word(words[i].as_py()), np.int64) for i in np.flatnonzero(~short).tolist()}
        pieces, done = [], 0
        for i, x in far.items():                              # the few long words between the others
            upto = int(length[:i][short[:i]].sum())
            pieces += [ids[done:upto], x]
            length[i], done = len(x), upto
        return np.concatenate([*pieces, ids[done:]]), length

    def of_texts(self, different: pa.Array, at: np.ndarray, number: np.ndarray) -> pa.Array:
        """All texts' ids, each text's end included, as ``packed``.

        ``at`` names the words of all texts in ``different``, ``number`` says how many each text has.
        """
        ids, length = self.of_different(different)
        each = packed(np.append(ids, self.end), np.append(length, 1), self.size)
        upto = np.cumsum(number + 1)
        tokens = np.full(len(at) + len(number), len(different), np.int32)
        tokens[np.arange(len(at)) + np.repeat(np.arange(len(number)), number)] = at
        laid = each.take(pa.array(tokens))
        cuts = np.frombuffer(laid.buffers()[1], np.int32)[laid.offset:][np.append(0, upto)]
        return pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(cuts), laid.buffers()[2]])


_LOADED: dict[int, Subwords] = {}


def subwords(ranks: bytes) -> Subwords:
    """One encoder for each Python process."""
    key = hash(ranks)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Subwords(ranks)
    return _LOADED[key]


# -- counts of the corpus ---------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """``(word binary, n)`` over ``texts(text binary)``; the empty word counts the texts' ends.  Counted in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        texts = many = 0

        def out():
            got = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([got.field("values"), got.field("counts").cast(pa.int64())], ["word", "n"])

        for b in batches:
            words, _ = all_words(b.column(0))
            held.append(words)
            texts, many = texts + b.num_rows, many + len(words)
            if many > HELD:
                yield out()
                held.clear()
                many = 0
        if many:
            yield out()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([texts], pa.int64())], ["word", "n"])

    return map_arrow(texts, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each of ``size`` subword ids occurs in ``ids(ids binary)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(unpacked(b.column(0), size)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    got = map_arrow(ids, run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


# -- encoded texts ------------------------------------------------------------------

def packed(ids: np.ndarray, number: np.ndarray, size: int) -> pa.Array:
    """The ids of texts in a row, ``number`` of each, as one binary value a text; ids are below ``size``."""
    ids = np.ascontiguousarray(ids, np.min_scalar_type(size))
    upto = np.append(0, np.cumsum(number)) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(ids)])


def unpacked(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` was given: the ids in a row, and how many each text has."""
    kind = np.min_scalar_type(size)
    upto = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if upto[0] == upto[-1]:
        return np.zeros(0, kind), np.zeros(len(texts), np.int64)
    ids = np.frombuffer(texts.buffers()[2], np.uint8)[upto[0]:upto[-1]].view(kind)
    return ids, np.diff(upto).astype(np.int64) // kind.itemsize


def together(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches, joined until ``column`` has ``TEXT_AT_ONCE`` bytes: a word that many texts share is looked up once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.column(column).nbytes for x in held) >= TEXT_AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# -- windows ------------------------------------------------------------------------

def windows(ids: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The padded inputs of a text's windows, one after another at distance ``STEP``, and the ids that they predict.

    Window k reads inputs ``k * STEP`` to ``k * STEP + WINDOW`` and predicts ids ``k * STEP`` to ``(k + 1) * STEP``.
    """
    number = -(-len(ids) // STEP)
    inputs = np.full(WINDOW - STEP + number * STEP, end, np.int64)
    inputs[:WINDOW - STEP] = start
    inputs[WINDOW - STEP + 1:WINDOW - STEP + len(ids)] = ids[:-1]    # the first id follows an end
    return inputs, ids


# -- the network --------------------------------------------------------------------

@dataclass
class Model:
    slot: np.ndarray            # id -> output slot
    source: np.ndarray          # id -> input vector
    tail: np.ndarray            # id -> log10 share within its slot
    p: dict[str, np.ndarray]


def _setting(counts: np.ndarray, end: int) -> Model:
    """Slots by falling counts; the end of a text has one in any case, and the last one is for all subwords without."""
    order = np.argsort(-np.where(np.arange(len(counts)) == end, counts.max() + 1, counts), kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    slot = np.minimum(rank, SLOTS - 1)
    source = np.append(np.minimum(rank, INPUTS - 2), INPUTS - 1)      # the last id is the place before the start
    rest = slot == SLOTS - 1
    share = np.where(rest, counts + TAIL, 0.0)
    tail = np.where(rest, np.log10(np.where(rest, share / max(share.sum(), TAIL), 1.0)), 0.0)
    rng = np.random.default_rng(SEED)

    def some(*shape):
        return (rng.normal(size=shape) * 0.4 / np.sqrt(shape[-2])).astype(np.float32)

    n = np.bincount(slot, counts, SLOTS).reshape(CLASSES, MEMBERS) + TAIL
    p = {"E": (rng.normal(size=(INPUTS, DIM)) * 0.3).astype(np.float32), "P": some(WINDOW, DIM), "A": some(DIM, DIM),
         "V": some(DIM, DIM), "W": some(DIM, HIDDEN), "w": np.zeros(HIDDEN, np.float32), "U": some(HIDDEN, DIM),
         "C": some(DIM, CLASSES), "c": np.log(n.sum(1) / n.sum()).astype(np.float32),
         "M": some(CLASSES, DIM, MEMBERS), "m": np.log(n / n.sum(1, keepdims=True)).astype(np.float32)}
    return Model(slot.astype(np.int32), source.astype(np.int32), tail, p)


def lay(model: Model, ids: np.ndarray, size: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of many texts: their input numbers, each text's first window, and the place of each id in the windows' rows.

    A text's places lie in a row, ``STEP`` to a window; what its last window has beyond its end counts nothing.
    """
    number, before = -(-size // STEP), WINDOW - STEP
    first = np.cumsum(number) - number
    at = np.arange(len(ids)) + np.repeat(first * STEP - (np.cumsum(size) - size), size)
    late = np.full(int(number.sum()) * STEP, model.source[end])
    late[at[1:]] = model.source[ids[:-1]]
    # the first id of a text follows an end; a text that fills its last window is followed by another's first place
    late[first * STEP] = model.source[end]
    late = late.reshape(-1, STEP)
    x = np.empty((len(late), WINDOW), late.dtype)
    x[:, before:] = late
    x[1:, :before] = late[:-1, STEP - before:]
    x[first, :before] = model.source[start]
    return x, first, at


_BACK = np.where(np.arange(WINDOW)[None, :] <= np.arange(WINDOW)[:, None], 0, -np.inf).astype(np.float32)
#: The same for the last ``STEP`` places, key by key.
_AHEAD = np.ascontiguousarray(_BACK[WINDOW - STEP:].T)


def _hold(x: np.ndarray) -> None:
    np.clip(x, -_MOST, _MOST, out=x)


def _members(p: dict, o: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The members' logits of rows sorted by their class ``of``, and each class's rows."""
    z = p["m"].take(of, 0)
    cuts = np.searchsorted(of, np.arange(CLASSES + 1)).tolist()
    rows = [(k, slice(i, j)) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
    for k, at in rows:
        z[at] += o[at] @ p["M"][k]
    return z, rows


def _hidden(p: dict, x: np.ndarray) -> np.ndarray:
    """The last ``STEP`` places' vectors of windows ``x`` of input numbers.  Scores are held key by key, so that sums run along rows."""
    h = p["E"].take(x, 0)
    h += p["P"]
    late = h[:, WINDOW - STEP:]
    q = late.reshape(-1, DIM) @ (p["A"] * np.float32(DIM ** -0.5))
    a = h @ q.reshape(len(x), STEP, DIM).transpose(0, 2, 1)
    _hold(a)
    a += _AHEAD
    np.exp(a, out=a)
    o = a.transpose(0, 2, 1) @ (h.reshape(-1, DIM) @ p["V"]).reshape(h.shape)
    o /= a.sum(1)[:, :, None]
    o += late
    o = o.reshape(-1, DIM)
    z = o @ p["W"]
    z += p["w"]
    np.maximum(z, 0, out=z)
    o += z @ p["U"]
    return o


def _log_p(p: dict, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Natural log probability of each row's slot: of its class, then of the member of the class."""
    order = np.argsort(slot.astype(np.int16), kind="stable")
    slot, o, row = slot[order].astype(np.intp), h.take(order, 0), np.arange(len(order))
    of = slot // MEMBERS
    z = o @ p["C"]
    z += p["c"]
    _hold(z)
    found = z.ravel().take(row * CLASSES + of)
    np.exp(z, out=z)
    total = z @ np.ones(CLASSES, z.dtype)
    z, _ = _members(p, o, of)
    _hold(z)
    found += z.ravel().take(row * MEMBERS + slot % MEMBERS)
    np.exp(z, out=z)
    total *= z @ np.ones(MEMBERS, z.dtype)
    found -= np.log(total)
    out = np.empty_like(found)
    out[order] = found
    return out


def _errors(z: np.ndarray, at: np.ndarray) -> float:
    """Makes each row's logits the softmax less 1 at ``at`` (a place of ``z`` laid in a row), over the number of rows.

    Returns the sum of the log probabilities there.
    """
    _hold(z)
    found = z.ravel().take(at).sum()
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    found -= np.log(total).sum()
    total *= len(z)
    z /= total[:, None]
    z.ravel()[at] -= z.dtype.type(1 / len(z))
    return found


def _gradients(p: dict, x: np.ndarray, slot: np.ndarray, counted: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the counted places and its gradients; ``slot`` and ``counted`` are of the windows' last ``STEP`` places."""
    kind, before = p["E"].dtype, WINDOW - STEP
    scale = kind.type(DIM ** -0.5)
    A = p["A"] * scale
    h = p["E"].take(x, 0)
    h += p["P"]
    flat, late = h.reshape(-1, DIM), np.ascontiguousarray(h[:, before:]).reshape(-1, DIM)
    q = (late @ A).reshape(-1, STEP, DIM)
    a = q @ h.transpose(0, 2, 1)
    _hold(a)
    a += _BACK[before:]
    np.exp(a, out=a)
    over = 1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, kind))[:, None]  # on 16 numbers a place, not on 32 scores
    v = (flat @ p["V"]).reshape(h.shape)
    seen = (a @ v).reshape(-1, DIM)
    seen *= over
    r = late + seen
    z = r @ p["W"]
    z += p["w"]
    np.maximum(z, 0, out=z)
    out = z @ p["U"]
    out += r
    use = np.flatnonzero(counted.ravel())
    to = slot.ravel().take(use).astype(np.int16)
    order = np.argsort(to, kind="stable")
    to, use, row = to.take(order).astype(np.intp), use.take(order), np.arange(len(use))
    of, o, ones, g = to // MEMBERS, out.take(use, 0), np.ones(len(use), kind), {}
    pc = o @ p["C"]
    pc += p["c"]
    loss = -_errors(pc, row * CLASSES + of)
    g["C"], g["c"] = o.T @ pc, ones @ pc
    do = pc @ p["C"].T
    pm, classes = _members(p, o, of)
    loss -= _errors(pm, row * MEMBERS + to % MEMBERS)
    g["M"], g["m"] = np.zeros_like(p["M"]), np.zeros_like(p["m"])
    for k, at in classes:
        g["M"][k], g["m"][k] = o[at].T @ pm[at], ones[at] @ pm[at]
        do[at] += pm[at] @ p["M"][k].T
    d = np.zeros_like(out)
    d[use] = do
    g["U"] = z.T @ d
    dz = d @ p["U"].T
    dz *= z > 0
    g["W"], g["w"] = r.T @ dz, np.ones(len(dz), kind) @ dz
    d += dz @ p["W"].T
    dr = d * over
    to_scores = np.einsum("ij,ij->i", dr, seen).reshape(-1, STEP, 1)
    dr = dr.reshape(-1, STEP, DIM)
    dv = (a.transpose(0, 2, 1) @ dr).reshape(-1, DIM)
    ds = dr @ v.transpose(0, 2, 1)
    ds -= to_scores
    ds *= a
    dq = (ds @ h).reshape(-1, DIM)
    g["V"], g["A"] = flat.T @ dv, (late.T @ dq) * scale
    dh = ds.transpose(0, 2, 1) @ q
    dh += (dv @ p["V"].T).reshape(h.shape)
    d += dq @ A.T
    dh[:, before:] += d.reshape(dr.shape)
    g["P"] = (np.ones(len(x), kind) @ dh.reshape(len(x), -1)).reshape(WINDOW, DIM)
    at = x.ravel().astype(np.int16)
    order = np.argsort(at, kind="stable")
    at = at.take(order)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    g["E"] = np.zeros_like(p["E"])
    g["E"][at[first]] = np.add.reduceat(dh.reshape(-1, DIM).take(order, 0), first)
    return float(loss / len(use)), g


class _Adam:
    """Steps of Adam on ``p`` in place."""

    def __init__(self, p: dict):
        self.p, self.step = p, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def __call__(self, g: dict, rate: float) -> None:
        self.step += 1
        for k, v in g.items():
            first, second = self.first[k], self.second[k]
            some = v - first
            some *= 0.1
            first += some
            np.multiply(v, v, out=some)
            some -= second
            some *= 0.01
            second += some
            np.divide(second, 1 - 0.99 ** self.step, out=some)
            np.sqrt(some, out=some)
            some += 1e-8
            np.divide(first, some, out=some)
            some *= rate / (1 - 0.9 ** self.step)
            self.p[k] -= some


def train(model: Model, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray, steps: int = STEPS) -> list[float]:
    """Adam over random batches of windows; a tenth of them tells when to stop, and the best state there stays.  The losses there."""
    n = len(inputs)
    if n < 2:
        return []
    rng = np.random.default_rng(SEED)
    deal = rng.permutation(n)
    apart = max(1, n // 10)
    held, rest = deal[:apart], deal[apart:]
    x, y = model.source[inputs], model.slot[targets]

    def look() -> float:
        total, many = 0.0, 0
        for i in range(0, len(held), 256):
            at = held[i:i + 256]
            use = np.flatnonzero(counted[at].ravel())
            total -= _log_p(model.p, _hidden(model.p, x[at])[use], y[at].ravel()[use]).sum()
            many += len(use)
        return total / max(many, 1)

    p = model.p
    adam = _Adam(p)
    best, state, losses = look(), {k: v.copy() for k, v in p.items()}, []
    losses.append(best)
    worse = 0
    for step in range(1, steps + 1):
        at = rest[rng.integers(0, len(rest), min(BATCH, len(rest)))]
        _, g = _gradients(p, x[at], y[at], counted[at])
        adam(g, RATE * min(1.0, step / 50) * (0.1 + 0.9 * (1 - step / steps)))
        if step % LOOK == 0 or step == steps:
            losses.append(look())
            worse = worse + 1 if losses[-1] >= best else 0
            if losses[-1] < best:
                best, state = losses[-1], {k: v.copy() for k, v in p.items()}
            if worse >= PATIENCE:
                break
    model.p = state
    return losses


def sample(texts: DataFrame, enc: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where training starts: at most ``TRAIN_WINDOWS`` windows of ``texts(ids binary, h bigint)``: inputs, ids to predict, and which places count.

    Documents are picked by the hash ``h``, windows of a document by a generator
    seeded with it; of more windows, those with the smallest hashes are taken.
    """
    n = texts.count()
    share = min(1.0, 1.5 * TRAIN_WINDOWS / OF_A_TEXT / max(n, 1))
    of_a_text = max(OF_A_TEXT, TRAIN_WINDOWS // max(n, 1))
    start, end, size = enc.start, enc.end, enc.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, bytes, bytes]] = []
            every, many = unpacked(b.column(0), size)
            for ids, h in zip(np.split(every, np.cumsum(many)[:-1]), b.column(1).to_pylist()):
                inputs, ids = windows(ids, start, end)
                number = -(-len(ids) // STEP)
                rng = np.random.default_rng(h % (1 << 63))
                for k in rng.choice(number, min(of_a_text, number), replace=False).tolist():
                    to = ids[k * STEP:(k + 1) * STEP]
                    rows.append((int(rng.integers(0, 1 << 62)), inputs[k * STEP:k * STEP + WINDOW].astype("<i4").tobytes(),
                                 to.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                                             ["h", "x", "y"])

    picked = texts.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share)
    got = map_arrow(picked, run, "h bigint, x binary, y binary").orderBy("h", "x", "y").limit(TRAIN_WINDOWS).collect()
    inputs, targets = np.zeros((len(got), WINDOW), np.int64), np.zeros((len(got), STEP), np.int64)
    counted = np.zeros((len(got), STEP), bool)
    for i, r in enumerate(got):
        inputs[i] = np.frombuffer(r["x"], "<i4")
        y = np.frombuffer(r["y"], "<i4")
        targets[i, :len(y)], counted[i, :len(y)] = y, True
    return inputs, targets, counted


def learn(texts: DataFrame, enc: Subwords, model: Model) -> int:
    """Trains on every window of ``texts(ids binary, h bigint)``, each once; ``model`` is changed.  The number of windows.

    Documents are dealt to ``ROUNDS`` rounds by the hash ``h``.  In a round each task
    takes Adam steps over the windows of its own documents, from the state that the round began
    with.  What the tasks changed is averaged on Spark: an input vector by how often it was read,
    all else by windows.  The driver receives one state a round, whatever the input's size; which
    documents share a task depends on how the input is partitioned, and with it the last digits.
    """
    spark = texts.sparkSession
    fixed = spark.sparkContext.broadcast((enc.start, enc.end, enc.size, model.slot, model.source, model.tail))
    others = [k for k in model.p if k != "E"]
    seen = 0

    def total(rows: pa.Table) -> pa.Table:
        """What the tasks learned of one row of numbers, summed in the order of the tasks."""
        rows = rows.sort_by("task")
        n, v = (np.sum([np.frombuffer(r, "<f8") for r in rows[c].to_pylist()], axis=0).astype("<f8").tobytes() for c in ("n", "v"))
        return pa.table({"row": rows["row"][:1], "n": pa.array([n], pa.binary()), "v": pa.array([v], pa.binary())})

    for number in range(ROUNDS):
        state = spark.sparkContext.broadcast(model.p)
        rate = ROUND_RATE * (1 - number / ROUNDS)

        def run(batches: Iterator[pa.RecordBatch], number=number, rate=rate, state=state) -> Iterator[pa.RecordBatch]:
            start, end, size, slots, source, tail = fixed.value
            began = state.value
            m = Model(slots, source, tail, {k: v.copy() for k, v in began.items()})
            task = TaskContext.get().partitionId()
            rng, adam, windows = np.random.default_rng((SEED, number, task)), _Adam(m.p), 0
            read = np.zeros(INPUTS, np.int64)
            waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def steps(all_of_them: bool) -> None:
                x, y, counted = (np.concatenate(a) for a in zip(*waiting))
                waiting.clear()
                deal = rng.permutation(len(x))
                cuts = list(range(0, len(x), BATCH)) if all_of_them else list(range(0, len(x) - BATCH + 1, BATCH))
                for k in cuts:
                    at = deal[k:k + BATCH]
                    adam(_gradients(m.p, x[at], y[at], counted[at])[1],
                         rate * min(1.0, (adam.step + 1) / 20) * len(at) / BATCH)
                rest = deal[len(cuts) * BATCH:]
                if len(rest):
                    waiting.append((x[rest], y[rest], counted[rest]))

            for b in batches:
                ids, many = unpacked(b.column(0), size)
                if not len(many):
                    continue
                x, _, at = lay(m, ids, many, start, end)
                y, counted = np.zeros(len(x) * STEP, slots.dtype), np.zeros(len(x) * STEP, bool)
                y[at], counted[at] = slots[ids], True
                waiting.append((x, y.reshape(-1, STEP), counted.reshape(-1, STEP)))
                windows += len(x)
                read += np.bincount(x.ravel(), minlength=INPUTS)
                if sum(len(w[0]) for w in waiting) >= BATCH:
                    steps(False)
            if waiting:
                steps(True)
            if windows:
                change = (m.p["E"].astype("<f8") - began["E"]) * read[:, None]
                rows = [(i, read[k:k + VECTORS_A_ROW].astype("<f8"), change[k:k + VECTORS_A_ROW])
                        for i, k in enumerate(range(0, INPUTS, VECTORS_A_ROW))]
                rows.append((-1, np.array([windows], "<f8"),
                             np.concatenate([(m.p[k].astype("<f8") - began[k]).ravel() for k in others]) * windows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
                    ["task", "row", "n", "v"])

        part = texts.where(F.pmod("h", F.lit(ROUNDS)) == number).select("ids")
        got = map_arrow(part, run, "task bigint, row bigint, n binary, v binary").groupBy("row").applyInArrow(
            total, "row bigint, n binary, v binary").collect()
        p = {k: v.copy() for k, v in model.p.items()}
        for r in got:
            n, v = np.frombuffer(r["n"], "<f8"), np.frombuffer(r["v"], "<f8")
            if r["row"] >= 0:
                at = slice(r["row"] * VECTORS_A_ROW, r["row"] * VECTORS_A_ROW + len(n))
                p["E"][at] += (v.reshape(len(n), DIM) / np.maximum(n, 1)[:, None]).astype(np.float32)
                continue
            seen += int(n[0])
            cuts = np.cumsum([p[k].size for k in others])[:-1]
            for k, change in zip(others, np.split(v / n[0], cuts)):
                p[k] += change.reshape(p[k].shape).astype(np.float32)
        model.p = p
        state.unpersist()
    return seen


# -- scores -------------------------------------------------------------------------

def log10_p(model: Model, ids: np.ndarray, size: np.ndarray, start: int, end: int) -> np.ndarray:
    """The log10 probability of each text: ``ids`` are all texts' ids in a row, ``size`` (at least 1) how many each has."""
    if not len(size):
        return np.zeros(0)
    x, first, at = lay(model, ids, size, start, end)
    slot = np.zeros(len(x) * STEP, model.slot.dtype)
    score = np.zeros(len(slot))
    used = np.zeros(len(slot), bool)
    slot[at], score[at], used[at] = model.slot[ids], model.tail[ids], True
    for i in range(0, len(x), OUTPUTS_AT_ONCE):
        some = range(i, min(i + OUTPUTS_AT_ONCE, len(x)), WINDOWS_AT_ONCE)
        h = np.concatenate([_hidden(model.p, x[k:min(k + WINDOWS_AT_ONCE, some.stop)]) for k in some])
        at = slice(i * STEP, some.stop * STEP)
        score[at] += _log_p(model.p, h, slot[at]) / np.log(10)
    return np.add.reduceat(np.where(used, score, 0), first * STEP)


@dataclass
class Counted:
    """What the baseline needs, and the vocabulary: totals, the broadcast counts, the counts table."""

    ranks: bytes
    tokens: int                 # N
    distinct: int               # V
    ends: int
    frequent: dict[bytes, int]
    counts: DataFrame


@dataclass
class Trained(Counted):
    """All that scoring needs."""

    model: Model
    losses: list[float]         # where training started
    windows: int                # learned from
    rows: DataFrame             # the documents given to ``fit``, encoded


def _is_frequent(tokens: int) -> Column:
    return (F.col("n") * FREQUENT >= tokens) & (F.length("word") <= SHORT) & (F.length("word") > 0)


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train_on: Column | None = None,
        vocabulary: str = VOCABULARY, steps: int = STEPS) -> Trained:
    """Counts all training documents and trains the network on all their windows.

    Training documents are those for which ``train_on`` holds, by default those not
    held out.  ``vocabulary`` is a file of byte-level BPE ranks (``base64 rank`` by line).
    """
    prepare(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    train_on = ~held_out(doc_id) if train_on is None else train_on
    counts = materialise(word_counts(docs.where(train_on).select(F.col(text).cast("binary").alias("text"))), "op12-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.coalesce(F.max(F.when(F.length("word") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    few = counts.where(_is_frequent(total["n"])).toArrow()             # at most FREQUENT words of SHORT bytes
    frequent = dict(zip(few["word"].to_pylist(), few["n"].to_pylist()))
    counted = Counted(ranks, total["n"], total["v"], total["ends"], frequent, counts)
    rows, enc = encode(docs, counted, text, doc_id, train_on), subwords(ranks)
    src = rows.where("train").select("ids", "h")
    model = _setting(subword_counts(src.select("ids"), enc.size), enc.end)
    losses = train(model, *sample(src, enc), steps=steps)
    return Trained(**vars(counted), model=model, losses=losses, windows=learn(src, enc, model), rows=rows)


def _share(n, tokens: int, distinct: int):
    """The baseline's probability of a word that occurs ``n`` times in training."""
    return (n + 0.1) / (tokens + 0.1 * (distinct + 1))


def encode(docs: DataFrame, counted: Counted, text: str, doc_id: str, train_on: Column | None = None) -> DataFrame:
    """A written table of all rows: ``uid, doc_id, held_out, train, h, n_tokens, known, base, others, ids``.

    ``ids`` are the subwords and the end, packed; ``base`` and ``known`` are of the end and the
    frequent words, ``others`` lists the other words and how often each occurs; ``h`` is a hash of the row.
    """
    spark = docs.sparkSession
    prepare(spark)
    t = counted
    shared = spark.sparkContext.broadcast((t.ranks, t.tokens, t.distinct, t.ends, t.frequent))
    kind = docs.schema[doc_id].dataType.simpleString()
    rare = pa.struct([("w", pa.binary()), ("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, tokens, distinct, ends, frequent = shared.value
        enc = subwords(ranks)
        known = pa.array(list(frequent), pa.binary())
        logs = np.append(np.log10(_share(np.array(list(frequent.values()), float), tokens, distinct)), 0.0)
        end = float(np.log10(_share(ends, tokens, distinct)))
        for b in together(batches, 5):
            words, number = all_words(b.column(5))
            words = words.dictionary_encode()
            at, names = words.indices.to_numpy(), words.dictionary
            found = pc.fill_null(pc.index_in(names, value_set=known), len(known)).to_numpy()
            frequently, log = found < len(known), logs[found]
            doc = np.repeat(np.arange(len(number)), number)
            few = ~frequently[at]
            pairs, times = np.unique(doc[few] * len(names) + at[few], return_counts=True)
            others = np.bincount(doc[few], minlength=len(number))
            base = end + np.bincount(doc, log[at], len(number))
            ids = enc.of_texts(names, at, number)
            at = np.searchsorted(pairs, np.arange(len(number) + 1) * len(names))
            names = names.take(pa.array(pairs % max(len(names), 1)))
            rest = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                [names, pa.array(times, pa.int64())], fields=list(rare)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(number + 1), pa.array(number - others + int(ends > 0)), pa.array(base, pa.float64()),
                 rest, ids],
                ["uid", "doc_id", "held_out", "train", "h", "n_tokens", "known", "base", "others", "ids"])

    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"),
                      F.coalesce(F.lit(False) if train_on is None else train_on, F.lit(False)).alias("train"),
                      F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.col(text).cast("binary").alias("text"))
    return materialise(map_arrow(src, run, f"uid bigint, doc_id {kind}, held_out boolean, train boolean, h bigint, n_tokens bigint, known bigint, "
                                 "base double, others array<struct<w: binary, k: bigint>>, ids binary"), "op12-encoded", compression="zstd")


def score(docs: DataFrame, trained: Trained, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words and one end.  ``base_score`` is the sum of the tokens' log10
    shares, ``score`` the network's log10 probability of the words' subwords and
    the end.  Frequent words' counts are broadcast; a document's other words are
    joined with the counts table.  Null texts count as empty: one token, the end.
    Repeated rows and null ids are rows like others (a null id is held out, as crc32
    of the empty string is 0); an empty table gives an empty result.  Without training
    documents every base score is 0 and the network is as it began.  Only the two columns are read.
    """
    return score_rows(encode(docs, trained, text, doc_id), trained)


def score_rows(rows: DataFrame, trained: Trained) -> DataFrame:
    """``score`` of what ``encode`` made of the documents."""
    t, enc = trained, subwords(trained.ranks)
    shared = rows.sparkSession.sparkContext.broadcast((t.model, enc.start, enc.end, enc.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, start, end, vocabulary = shared.value
        for b in batches:
            ids, size = unpacked(b.column(6), vocabulary)
            # texts of about IDS_AT_ONCE subwords at once
            cuts, upto = [0], np.cumsum(size)
            while cuts[-1] < len(size):
                before = int(upto[cuts[-1] - 1]) if cuts[-1] else 0
                cuts.append(min(int(np.searchsorted(upto, before + IDS_AT_ONCE)) + 1, len(size)))
            scores = [log10_p(model, ids[upto[i] - size[i]:upto[k - 1]], size[i:k], start, end) for i, k in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(np.concatenate([np.zeros(0), *scores]))],
                                             ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = materialise(map_arrow(rows.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "ids"), run,
                                   f"uid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double"),
                         "op12-scored")
    # as many rows as documents have different infrequent words; no word of these has many
    listed = rows.select("uid", F.explode("others").alias("o")).select("uid", F.col("o.w").alias("word"), F.col("o.k").alias("k"))
    found = t.counts.where(~_is_frequent(t.tokens) & (F.length("word") > 0))
    n = F.coalesce(F.col("n"), F.lit(0))
    rest = listed.join(found, "word", "left").groupBy("uid").agg(
        F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * F.log10(_share(n, t.tokens, t.distinct))).alias("more_base"))
    return scored.join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(t.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    trained = fit(documents(spark, sf_dir))
    return score_rows(trained.rows, trained)

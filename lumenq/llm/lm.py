"""Language-model scores: a gated recurrent network with class-factored output.

Symbols are the MODEL_WORDS most frequent training tokens and TAIL buckets
for all others, told apart by their last two bytes. The network predicts the
symbol (class, then symbol within its class); inside a bucket a token has its
add-half share of the bucket's training tokens, so the score is a log10
probability of the whole text on the same footing as the base score.

Counts cover every training token: one row per distinct token of a batch is
shuffled. Every text outside the held fold is then cut into pieces of PIECE
symbols, written once and dealt by a hash of id, text and place over shards of
about SHARD tokens and over ROUNDS rounds, so each training token is read in
one round, and weights do not depend on how the table lies. Training is
truncated back-propagation in numpy, shard by shard; after a round the shards'
weights are averaged by a tree of small aggregations. Scoring packs whole texts
into lanes and carries the state from window to window to the end of each
text; lanes are held flat, so memory grows with the tokens of a batch and not
with its longest text. Counts of the HEAD most frequent tokens are broadcast
(fixed size); the others are joined by a shuffle of (row, rare token).

A null text is empty and has only its end token; a null id is of the fold of
the empty text. Repeated rows are scored alike and counted as often as they
occur. Without training rows every count is 0 and both scores are those of an
empty model; an empty table gives no rows. Token identity rests on 64-bit
hashes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Prefix, chunks, lowered, mix, one_thread, release, remainder, runs, saved, spread, text_bytes

MODEL_WORDS, TAIL, CLASSES, HIDDEN, HEAD = 2048, 32, 48, 24, 1 << 18
PIECE, SHARD, ROUNDS, STEPS, LANES, RATE = 64, 1 << 20, 2, 16, 64, 0.01
SCORE_LANES, WINDOW, STEEP = 512, 32, 80
BLOCK, BYTES = 1 << 14, 1 << 17  # weights of a step and bytes of text taken at once: what stays in the cache
END = np.uint64(0x5E4D0FE4D)
_KINDS = TAIL  # the end token has a bucket of its own


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bucket of every token of the texts in turn, and the texts' cuts."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    keys, kinds, many = [], [], np.ones(n, np.int64)
    for i, j in chunks(offsets, BYTES):
        mine = lowered(data[offsets[i] : offsets[j]])
        cut = offsets[i : j + 1] - offsets[i]
        starts, ends, owner = runs((mine != 0x20) & (mine - np.uint8(0x09) > 4), cut)
        here = np.bincount(owner, minlength=j - i)
        many[i:j] += here
        last = mine[ends - 1].astype(np.uint64) << np.uint64(8)
        last |= np.where(ends - starts > 1, mine[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        after = np.cumsum(here)
        keys.append(np.insert(Prefix(mine)(starts, ends, salt=11), after, END))
        kinds.append(np.insert((mix(last) % np.uint64(TAIL)).astype(np.int32), after, _KINDS))
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *keys]), np.concatenate([empty.astype(np.int32), *kinds]), np.concatenate([[0], np.cumsum(many)])


def _count(batches):
    for batch in batches:
        keys, kinds, _ = tokens(batch.column(0))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        keys, n, first = keys[first], np.diff(np.append(first, len(keys))), order[first]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds[first]), pa.array(n, pa.int64())], names=["token", "kind", "n"])


class Places:
    """Places of hashes in a sorted array of them: a table by their first bits
    leads to the few that share these."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, len(keys).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``find``; the place of a hash that is not there is of no use."""
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        known = (self.keys[at] == wanted) & (at < end)
        left = np.flatnonzero(~known & (end - at > 1))
        while len(left):
            at[left] += 1
            here = at[left]
            hit = self.keys[here] == wanted[left]
            known[left] = hit
            left = left[~hit & (here + 1 < end[left])]
        at[at == len(self.keys) - 1] = 0
        return at, known


class Vocabulary:
    """Exact counts of the frequent tokens, and the symbols with their classes."""

    def __init__(self, head: pa.Table, kinds: dict[int, tuple[int, int]], total: int, distinct: int):
        key = head.column("token").to_numpy().view(np.uint64)
        n = head.column("n").to_numpy().astype(np.int64)
        kind = head.column("kind").to_numpy().astype(np.int64)
        order = np.argsort(key)
        self.keys, self.counts = key[order], n[order]
        self.total, self.distinct = total, distinct
        top = min(MODEL_WORDS, len(key))
        mass = np.zeros(top + TAIL + 1)
        mass[:top] = n[:top]
        size = np.zeros(TAIL + 1)
        for k, (m, v) in kinds.items():
            mine = kind[:top] == k
            mass[top + k] = m - n[:top][mine].sum()
            size[k] = v - mine.sum()
        self.tail_mass = mass[top:] + 0.5 * (size + 1)
        mass[top:] = self.tail_mass
        # symbols by falling mass, classes of equal shares of the root mass
        by_mass = np.argsort(-mass, kind="stable")
        root = np.sqrt(mass[by_mass] + 0.5)
        cls = np.minimum((np.cumsum(root) - root) / root.sum() * CLASSES, CLASSES - 1).astype(np.int64)
        cls = np.unique(cls, return_inverse=True)[1]
        self.symbol = np.empty(len(mass), np.int32)
        self.symbol[by_mass] = np.arange(len(mass))
        self.cls = cls
        self.cuts = np.concatenate([[0], np.flatnonzero(np.diff(cls)) + 1, [len(mass)]])
        self.log_mass = np.log(np.maximum(mass[by_mass], 0.5) / mass.sum())
        words = np.argsort(key[:top])
        self.word_keys, self.word_rank = key[:top][words], words
        self.top = top
        #: Of each frequent token its symbol (-1 in a bucket) and the logarithm of its count.
        self.key_symbol = np.full(len(key), -1, np.int32)
        self.key_symbol[np.searchsorted(self.keys, key[:top])] = self.symbol[:top]
        self.key_log, self.tail_log = np.log10(self.counts + 0.5), np.log10(self.tail_mass)

    def symbols(self, keys: np.ndarray, kinds: np.ndarray, places: Places | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each token, and which are in a bucket; ``places`` are those of ``word_keys``."""
        at, known = (places or Places(self.word_keys))(keys)
        place = np.where(known, self.word_rank[at] if self.top else 0, self.top + kinds)
        return self.symbol[place], ~known


def views(flat: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
    """The weights of the network in one vector, by name; output weights end with their bias."""
    n, c = len(v.cls), int(v.cls[-1]) + 1
    out, at = {}, 0
    for name, shape in (("x", (n, 3 * HIDDEN)), ("u", (HIDDEN, 3 * HIDDEN)), ("wc", (HIDDEN + 1, c)), ("wo", (n, HIDDEN + 1))):
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def fresh(v: Vocabulary) -> np.ndarray:
    """Weights that start as the unigram model."""
    rng = np.random.default_rng(11)
    n, c = len(v.cls), int(v.cls[-1]) + 1
    by_class = np.logaddexp.reduceat(v.log_mass, v.cuts[:-1])
    flat = np.zeros(n * (4 * HIDDEN + 1) + HIDDEN * (3 * HIDDEN + c) + c, np.float32)
    w = views(flat, v)
    for name, scale in (("x", 0.1), ("u", 0.1), ("wc", 0.01), ("wo", 0.01)):
        w[name][:] = rng.normal(0, scale, w[name].shape)
    w["wc"][-1], w["wo"][:, -1] = by_class, v.log_mass - by_class[v.cls]
    return flat


def turned(u: np.ndarray) -> np.ndarray:
    """State weights as ``cell`` takes them: those of the gates with the other sign."""
    u = u.copy()
    u[:, : 2 * HIDDEN] *= -1
    return u


def cell(u: np.ndarray, h: np.ndarray, gates: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of the gated unit: state after it, and the state's part in the
    new value. ``gates`` (update, reset) and ``new`` hold what the symbols put
    in, that of the gates with the other sign (as in ``turned``), and afterwards
    their values."""
    s = h @ u
    gates += s[:, : 2 * HIDDEN]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    side = s[:, 2 * HIDDEN :]
    new += gates[:, HIDDEN:] * side
    np.tanh(new, out=new)
    out = h - new
    out *= gates[:, :HIDDEN]
    out += new
    return out, side


def by_class(w: dict, v: Vocabulary) -> list[np.ndarray]:
    """Views of the output weights, class by class; they follow the weights."""
    return [w["wo"][a:b] for a, b in zip(v.cuts[:-1].tolist(), v.cuts[1:].tolist(), strict=True)]


def output(w: dict, v: Vocabulary, h: np.ndarray, symbol: np.ndarray, grads: dict | None = None, members: tuple | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each symbol given the state before it; with
    ``grads`` (zero before) also the gradient of the negative sum by state, and by weight.
    ``members``: ``by_class`` of the weights and of the gradients, where a caller keeps them."""
    inside, inside_grads = members or (by_class(w, v), None if grads is None else by_class(grads, v))
    cls = v.cls.astype(np.int16)[symbol]
    order = np.argsort(cls, kind="stable")  # of 16-bit numbers: by radix
    symbol, cls = symbol[order], cls[order]
    one = np.ones((len(h), HIDDEN + 1), h.dtype)  # the state and a constant for the bias
    one[:, :HIDDEN] = h[order]
    p = one @ w["wc"]
    np.clip(p, -STEEP, STEEP, out=p)  # in reach of exp; classes are few and small, so their sums are too
    hit = np.arange(0, p.size, p.shape[1]) + cls
    out = p.ravel()[hit]
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], p.dtype)
    out -= np.log(total)
    back = None
    if grads is not None:
        p *= (1 / total)[:, None]
        p.ravel()[hit] -= 1
        np.matmul(one.T, p, out=grads["wc"])
        back = p @ w["wc"].T
    # the symbols of each token's class, one token after another
    size = np.diff(v.cuts)
    many = np.bincount(cls, minlength=len(size))
    wide = size[cls]
    starts = np.cumsum(wide)
    flat = np.empty(int(starts[-1]), h.dtype)
    starts -= wide
    bounds, begins = np.cumsum(many).tolist(), np.cumsum(many * size).tolist()
    parts, a, i = [], 0, 0
    for c, (b, j) in enumerate(zip(bounds, begins, strict=True)):
        if b > a:
            rows, part = one[a:b], flat[i:j].reshape(b - a, -1)
            np.matmul(rows, inside[c].T, out=part)
            parts.append((c, a, b, rows, part))
        a, i = b, j
    hit = starts + symbol - v.cuts[cls]
    np.clip(flat, -STEEP, STEEP, out=flat)
    out += flat[hit]
    np.exp(flat, out=flat)
    total = np.add.reduceat(flat, starts)
    out -= np.log(total)
    logp, states = np.empty_like(out), None
    logp[order] = out
    if grads is not None:
        flat *= np.repeat(1 / total, wide)
        flat[hit] -= 1
        own = np.empty_like(one)
        for c, a, b, rows, part in parts:
            np.matmul(part.T, rows, out=inside_grads[c])
            np.matmul(part, inside[c], out=own[a:b])
        back += own
        states = np.empty_like(h)
        states[order] = back[:, :HIDDEN]
    return logp, states


def gradients(w: dict, v: Vocabulary, h: np.ndarray, symbol: np.ndarray, begin: np.ndarray, grads: dict, members: tuple | None = None) -> tuple[float, np.ndarray]:
    """Truncated back-propagation over one window (steps x lanes; symbol -1 is
    padding, ``begin`` marks first tokens): loss and state after it; the
    gradients go to ``grads``, zero before. What does not need the step before is
    worked out for the whole window at once."""
    steps, lanes = symbol.shape
    real = symbol >= 0
    every = bool(real.all())  # then nothing is to be picked out
    fed = np.maximum(symbol, 0)
    put, u = np.take(w["x"], fed, axis=0), turned(w["u"])
    gates, new = np.negative(put[:, :, : 2 * HIDDEN]), put[:, :, 2 * HIDDEN :].copy()
    before, side = np.empty_like(new), np.empty_like(new)
    fresh_at = begin.any(1).tolist()
    for t in range(steps):
        if fresh_at[t]:
            h = np.where(begin[t][:, None], new.dtype.type(0), h)
        before[t] = h
        h, side[t] = cell(u, h, gates[t], new[t])
    logp, back = output(w, v, before.reshape(-1, HIDDEN) if every else before[real], symbol.ravel() if every else symbol[real], grads, members)
    if every:
        dh_all = back.reshape(before.shape)
    else:
        dh_all = np.zeros_like(before)
        dh_all[real] = back  # from the output; the loop adds what comes back through time
    update, reset = gates[..., :HIDDEN], gates[..., HIDDEN:]
    by_new = (1 - update) * (1 - new * new)
    # of the update gate, the reset gate and the state's part in the new value, by the state's gradient
    # and of the state itself, which comes back as it is
    ds = np.empty((steps, lanes, 4, HIDDEN), put.dtype)
    ds[:, :, 0] = (before - new) * update * (1 - update)
    ds[:, :, 2] = by_new * reset
    ds[:, :, 1] = ds[:, :, 2] * side * (1 - reset)
    ds[:, :, 3] = update
    after = np.empty_like(before)  # gradient by the state after each step
    after[-1] = 0
    u_back = np.concatenate([w["u"].T, np.eye(HIDDEN, dtype=put.dtype)])
    for t in range(steps - 1, -1, -1):
        part = ds[t]
        part *= after[t][:, None, :]
        if t:
            dh = after[t - 1]
            np.matmul(part.reshape(lanes, -1), u_back, out=dh)
            dh += dh_all[t]
            if fresh_at[t]:
                dh[begin[t]] = 0
    flat = ds.reshape(-1, 4 * HIDDEN)[:, : 3 * HIDDEN]
    np.matmul(before.reshape(-1, HIDDEN).T, flat, out=grads["u"])
    flat[:, 2 * HIDDEN :] = (after * by_new).reshape(-1, HIDDEN)  # now by what the symbols put in
    fed = fed.ravel().astype(np.int16)
    order = np.argsort(fed, kind="stable")
    fed = fed[order]
    first = np.flatnonzero(np.concatenate([[True], fed[1:] != fed[:-1]]))
    grads["x"][fed[first]] = np.add.reduceat(flat[order], first)
    return float(-logp.sum()), h


class Lanes:
    """Pieces laid end to end in lanes of about equal length, the longest lane
    first; held flat, lane after lane, so as large as the pieces are."""

    def __init__(self, pieces: list[np.ndarray], n_lanes: int):
        load = [(0, b) for b in range(min(n_lanes, max(1, len(pieces))))]
        place: list[list[int]] = [[] for _ in load]
        for k in sorted(range(len(pieces)), key=lambda k: -len(pieces[k])):
            n, b = heapq.heappop(load)
            place[b].append(k)
            heapq.heappush(load, (n + len(pieces[k]), b))
        long = sorted(((n, b) for n, b in load), reverse=True)
        self.length = np.array([n for n, _ in long])
        self.start = np.cumsum(self.length) - self.length
        inside = [k for _, b in long for k in place[b]]
        size = np.array([len(pieces[k]) for k in inside])
        self.symbol = np.concatenate([pieces[k] for k in inside]) if inside else np.zeros(0, np.int32)
        self.piece = np.repeat(inside, size)
        self.begin = np.zeros(len(self.symbol), bool)
        self.begin[(np.cumsum(size) - size)[size > 0]] = True

    def windows(self, steps: int):
        """Symbols (steps x lanes, -1 after the end), first tokens, piece numbers of each window;
        lanes end one after another, the last ones first."""
        for t in range(0, int(self.length[0]), steps):
            at = np.arange(t, min(t + steps, int(self.length[0])))[:, None]
            length = self.length[self.length > t]
            real = at < length
            at = np.where(real, self.start[: len(length)] + at, 0)
            yield np.where(real, self.symbol[at], -1), self.begin[at] & real, self.piece[at]


class Adam:
    """Steps on one vector of weights, in place and by blocks that stay in the
    processor's cache. The running means are kept without their constant
    factors, 0.1 and 0.01, which go into the last product. Those of the input
    weights, the first ``n`` rows, also leave out their decay since ``base``, so
    that only rows with a gradient change; all rows take their step."""

    def __init__(self, flat: np.ndarray, n: int):
        self.t = self.base = 0
        self.first = n * 3 * HIDDEN
        self.mean, self.square, self.root = (np.zeros((n, 3 * HIDDEN), flat.dtype) for _ in range(3))
        spare = np.empty(BLOCK, flat.dtype)
        cuts = lambda a, b: [slice(k, min(k + BLOCK, b)) for k in range(a, b, BLOCK)]
        self.inputs = [(flat[c], self.mean.ravel()[c], self.root.ravel()[c], spare[: c.stop - c.start]) for c in cuts(0, self.first)]
        self.others = [(c, flat[c], np.zeros_like(flat[c]), np.zeros_like(flat[c]), spare[: c.stop - c.start]) for c in cuts(self.first, len(flat))]
        self.flat = flat

    def step(self, g: np.ndarray, scale: float, rows: np.ndarray) -> None:
        """``rows`` of the input weights have a gradient; that of the others is zero afterwards."""
        self.t += 1
        by = (0.01 / (1 - 0.99**self.t)) ** 0.5
        scale, least, rate = np.float32(scale), 1e-6 / by, RATE * 0.1 / (1 - 0.9**self.t) / by
        late = self.t - self.base
        mine = g[: self.first].reshape(self.mean.shape)[rows]
        mine *= scale
        np.clip(mine, -1, 1, out=mine)
        self.mean[rows] += mine * np.float32(0.9**-late)
        mine *= mine
        mine *= np.float32(0.99**-late)
        mine += self.square[rows]
        self.square[rows] = mine
        self.root[rows] = np.sqrt(mine, out=mine)
        shrunk = 0.99 ** (late / 2)
        add, times = np.float32(least / shrunk), np.float32(rate * 0.9**late / shrunk)
        for flat, mean, root, spare in self.inputs:
            np.add(root, add, out=spare)
            np.divide(mean, spare, out=spare)
            spare *= times
            flat -= spare
        if late == 128:
            self.mean *= np.float32(0.9**late)
            self.square *= np.float32(0.99**late)
            self.root *= np.float32(shrunk)
            self.base = self.t
        least, rate = np.float32(least), np.float32(rate)
        for cut, flat, mean, square, spare in self.others:
            mine = g[cut]
            mine *= scale
            np.clip(mine, -1, 1, out=mine)
            mean *= np.float32(0.9)
            mean += mine
            mine *= mine
            square *= np.float32(0.99)
            square += mine
            mine.fill(0)
            np.sqrt(square, out=spare)
            spare += least
            np.divide(mean, spare, out=spare)
            spare *= rate
            flat -= spare


def fit(v: Vocabulary, pieces: list[np.ndarray], optimizer: Adam) -> int:
    w, g = views(optimizer.flat, v), np.zeros_like(optimizer.flat)
    grads, seen = views(g, v), 0
    members = by_class(w, v), by_class(grads, v)
    h = np.zeros((LANES, HIDDEN), np.float32)
    for symbol, begin, _ in Lanes(pieces, LANES).windows(STEPS):
        _, h = gradients(w, v, h[: symbol.shape[1]], symbol, begin, grads, members)
        many = np.bincount(symbol[symbol >= 0], minlength=len(v.cls))
        n = int(many.sum())
        optimizer.step(g, 1 / n, np.flatnonzero(many))
        seen += n
    return seen


def log10_probabilities(w: dict, v: Vocabulary, pieces: list[np.ndarray]) -> np.ndarray:
    """Of each whole piece, window by window with the state carried on."""
    out = np.zeros(len(pieces))
    if not pieces:
        return out
    h = np.zeros((SCORE_LANES, HIDDEN), np.float32)
    for_gates, for_new, u = -w["x"][:, : 2 * HIDDEN], w["x"][:, 2 * HIDDEN :].copy(), turned(w["u"])
    members = by_class(w, v), None
    for symbol, begin, piece in Lanes(pieces, SCORE_LANES).windows(WINDOW):
        h, fresh_at, put = h[: symbol.shape[1]], begin.any(1).tolist(), np.maximum(symbol, 0)
        before = np.empty((*symbol.shape, HIDDEN), np.float32)
        for t in range(len(symbol)):
            if fresh_at[t]:
                h = np.where(begin[t][:, None], np.float32(0), h)
            before[t] = h
            h = cell(u, h, np.take(for_gates, put[t], axis=0), np.take(for_new, put[t], axis=0))[0]
        real = symbol >= 0
        if real.all():  # then nothing is to be picked out
            real, before = slice(None), before.reshape(-1, HIDDEN)
            symbol, piece = symbol.ravel(), piece.ravel()
        logp, _ = output(w, v, before[real], symbol[real], members=members)
        out += np.bincount(piece[real], weights=logp, minlength=len(pieces))
    return out / np.log(10)


def _average(batches):
    """Mean weights of each group of shards by their tokens; rows come sorted."""
    group, total, mean = None, 0.0, None
    schema = pa.schema([("shard", pa.int32()), ("n", pa.float64()), ("weights", pa.binary())])
    done = lambda: pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], schema=schema)
    for batch in batches:
        for k, (g, n) in enumerate(zip(batch.column("grouped").to_pylist(), batch.column("n").to_pylist(), strict=True)):
            w = np.frombuffer(batch.column("weights")[k].as_buffer(), np.float32)
            if g != group:
                if group is not None:
                    yield done()
                group, total, mean = g, 0.0, np.zeros(len(w))
            total += n
            mean += (w - mean) * (n / total)
    if group is not None:
        yield done()


def _averaged(trained: DataFrame, shards: int) -> np.ndarray | None:
    """The shards' mean weights by token; 32 of them make one at a time."""
    trained = saved(trained, "weights")
    while shards > 1:
        shards = -(-shards // 32)
        grouped = trained.withColumn("grouped", F.floor(F.col("shard") / 32).cast("int")).repartition(shards, "grouped").sortWithinPartitions("grouped", "shard")
        before, trained = trained, saved(grouped.mapInArrow(_average, "shard int, n double, weights binary"), "weights")
        release(before)
    found = trained.limit(1).collect()
    release(trained)
    return np.frombuffer(found[0]["weights"], np.float32).copy() if found else None


def _pieces(batches, v: Vocabulary, shards: int):
    """Pieces of texts as packed symbols, with the shard, round and place of each."""
    places = Places(v.word_keys)
    for batch in batches:
        keys, kinds, cuts = tokens(batch.column("text"))
        symbol = v.symbols(keys, kinds, places)[0].astype("<i2")
        many = -(-np.diff(cuts) // PIECE)
        owner = np.repeat(np.arange(len(many)), many)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        ends = np.append(cuts[owner] + index * PIECE, cuts[-1]).astype(np.int32) * 2
        text = mix(batch.column("key").to_numpy().view(np.uint64))[owner]
        place = mix(text + index.astype(np.uint64) * np.uint64(ROUNDS + 1))
        turn = (text + index.astype(np.uint64)) % np.uint64(ROUNDS)
        packed = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(symbol.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array((place % np.uint64(shards)).astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(place.view(np.int64)), packed], names=["shard", "turn", "place", "symbols"])


def _train(batches, v: Vocabulary, start: np.ndarray):
    """Weights of each shard after its pieces; rows come sorted by shard and place."""
    shard, optimizer, seen, held, size = None, None, 0, [], 0
    schema = pa.schema([("shard", pa.int32()), ("n", pa.float64()), ("weights", pa.binary())])
    done = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(seen)]), pa.array([optimizer.flat.tobytes()], pa.binary())], schema=schema)
    for batch in batches:
        for s, packed in zip(batch.column("shard").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
            if s != shard:
                if shard is not None:
                    seen += fit(v, held, optimizer) if held else 0
                    yield done()
                shard, optimizer, seen, held, size = s, Adam(start.copy(), len(v.cls)), 0, [], 0
            held.append(np.frombuffer(packed, "<i2").astype(np.int32))
            size += len(held[-1])
            if size >= LANES * PIECE * 16:
                seen += fit(v, held, optimizer)
                held, size = [], 0
    if shard is not None:
        seen += fit(v, held, optimizer) if held else 0
        yield done()


def learn(texts: DataFrame) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """Vocabulary, weights and the table of all counts, from columns ``key`` (tells texts apart) and ``text``."""
    one_thread(texts.sparkSession)
    counts = texts.select("text").mapInArrow(_count, "token long, kind int, n long").groupBy("token").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))
    counts = saved(counts, "counts")
    kinds = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    head = counts.orderBy(F.desc("n"), "token").limit(HEAD).toArrow()
    vocabulary = Vocabulary(head, kinds, sum(n for n, _ in kinds.values()), sum(v for _, v in kinds.values()))
    flat = fresh(vocabulary)
    if not vocabulary.total:
        return vocabulary, flat, counts
    context = texts.sparkSession.sparkContext
    shards = -(-vocabulary.total // SHARD)
    shipped = context.broadcast(vocabulary)
    pieces = saved(texts.select("key", "text").mapInArrow(lambda batches: _pieces(batches, shipped.value, shards), "shard int, turn int, place long, symbols binary"), "pieces")
    for turn in range(ROUNDS):
        start = context.broadcast(flat)
        mine = spread(pieces.where(F.col("turn") == turn).select("shard", "place", "symbols"), "shard").sortWithinPartitions("shard", "place", "symbols")
        trained = mine.mapInArrow(lambda batches, start=start: _train(batches, shipped.value, start.value), "shard int, n double, weights binary")
        mean = _averaged(trained, shards)
        flat = flat if mean is None else mean
        start.unpersist()
    release(pieces)
    return vocabulary, flat, counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of each row; rows with crc32(id) mod ``fold`` = ``held`` are not learned from."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, fold) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    vocabulary, flat, counts = learn(rows.where("not held_out").select(F.xxhash64("doc_id", "text").alias("key"), "text"))
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))  # HEAD counts and the network: fixed size

    def run(batches):
        v, net = shipped.value[0], views(shipped.value[1], shipped.value[0])
        places = Places(v.keys)
        for batch in batches:
            keys, kinds, cuts = tokens(batch.column("text"))
            n = len(cuts) - 1
            at, known = places(keys)
            symbol = np.where(known, v.key_symbol[at] if len(v.keys) else -1, -1)
            tail = symbol < 0
            symbol = np.where(tail, v.symbol[v.top + kinds], symbol)
            logs = np.where(known, v.key_log[at] if len(v.keys) else 0.0, 0.0)
            total = lambda values: np.add.reduceat(values, cuts[:-1]) if n else values  # noqa: E731 - every text has a token
            base = total(logs)
            own = log10_probabilities(net, v, [symbol[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            own += total(np.where(tail, logs - v.tail_log[kinds], 0.0))
            rare = keys[~known].view(np.int64)
            n_known = total(known.astype(np.int64))
            split = np.concatenate([[0], np.cumsum(np.diff(cuts) - n_known)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(cuts), pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(own), pa.ListArray.from_arrays(pa.array(split, pa.int32()), pa.array(rare))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "own", "rare"],
            )

    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, rare array<long>")
    scored = saved(scored.withColumn("key", F.monotonically_increasing_id()), "scored")
    rare = scored.select("key", F.explode("rare").alias("token")).join(counts.select("token", "n"), "token", "left")
    rare = rare.groupBy("key").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("logs"), F.count("n").alias("known"))
    out = scored.drop("rare").join(rare, "key", "left")
    logs, norm = F.coalesce("logs", F.lit(0.0)), float(np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("own") + logs).alias("score"),
    )

"""Document log-likelihood under a gated recurrent language model.

Word counts of all training documents give a smoothed unigram model. On top of
it a small recurrent network with gates (update and reset) predicts the next
token's class, and the token within its class: the frequent words have learned
softmaxes, the long tail is spread within classes of word shape by its corpus
counts. The network is trained with truncated backpropagation in numpy: tasks
each run over their shard of the training texts, and their weights are averaged
after each round. Scoring carries the state over windows, so the probability is
that of the whole document.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatscan.llm.common import bound_batches, stored, table
from threatscan.llm.quality import bucket

#: So many of the most frequent words at most are looked up in the worker; the counts of others come by a join.
NEAR = 100_000
#: Frequent words with a learned probability: GROUPS classes of as many words.
GROUPS, SIZE = 32, 32
FREQUENT = GROUPS * SIZE
#: Classes of word shape for all other words.
SHAPES = 31
END_CLASS = GROUPS + SHAPES
CLASSES = END_CLASS + 1
END_INPUT = FREQUENT + SHAPES
INPUTS = END_INPUT + 1
HIDDEN = 24
#: Tokens in a shard, about.
SHARD = 2_600_000
LEAST_SHARDS = 1
ROUNDS = 3
#: Lanes and steps of a training window; a shard is repeated until it has given so many updates in a round.
LANES, STEPS, LEAST_UPDATES = 128, 32, 60
RATE = 0.03
#: Added to the root mean square of a weight's gradients.
EPS = 1e-6

SHAPES_OF = [("x", (INPUTS, 3 * HIDDEN)), ("u", (HIDDEN, 2 * HIDDEN)), ("v", (HIDDEN, HIDDEN)), ("c", (HIDDEN, CLASSES)), ("cb", (CLASSES,)), ("w", (GROUPS, HIDDEN, SIZE)), ("wb", (GROUPS, SIZE))]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of all texts, split at ASCII white space only, and where each text's words begin, with the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, cuts = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64))
    real = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty words
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return flat.filter(real), before[cuts]


def shape(word: str) -> int:
    """The shape class of a word: by its last character and whether it is all ASCII."""
    return (2 * ord(word[-1]) + (not word.isascii())) % SHAPES


def shapes(distinct: pa.Array) -> np.ndarray:
    """``shape`` of each word."""
    last = pc.utf8_slice_codeunits(distinct, -1, None).dictionary_encode()
    code = np.array([ord(c) for c in last.dictionary.to_pylist()], dtype=np.int64)[last.indices.to_numpy()]
    return (2 * code + ~pc.string_is_ascii(distinct).to_numpy(zero_copy_only=False)) % SHAPES


def shape_column(word: str):
    return F.pmod(2 * F.ascii(F.right(F.col(word), F.lit(1))) + F.col(word).rlike(r"[^\x00-\x7F]").cast("int"), F.lit(SHAPES))


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, dims in SHAPES_OF:
        n = int(np.prod(dims))
        out[name] = flat[at : at + n].reshape(dims)
        at += n
    return out


def initial(vocab: dict) -> np.ndarray:
    """Small random weights; the biases alone give the unigram model."""
    rng = np.random.default_rng(11)
    flat = np.concatenate([rng.normal(0, 0.1, int(np.prod(dims))) for _, dims in SHAPES_OF]).astype(np.float32)
    p = unpack(flat)
    p["c"][:], p["w"][:] = 0, 0
    p["cb"][:], p["wb"][:] = vocab["class_bias"], vocab["word_bias"]
    return flat


class Encoder:
    """Turns texts into numbers of inputs: frequent words by rank, others by shape."""

    def __init__(self, vocab: dict):
        self.near, log_tail = pa.array(vocab["near"], pa.string()), vocab["log_tail"]
        own, n = shapes(self.near), len(self.near)
        frequent = np.arange(n) < FREQUENT
        # by rank; the last entry is for far words, whose shapes are filled in
        self.token = np.append(np.where(frequent, np.arange(n), FREQUENT + own), 0).astype("<u2")
        self.log = np.append(np.log10(vocab["near_count"] + 0.1), 0)
        self.tail = np.append(np.where(frequent, 0, self.log[:-1] - log_tail[own]), 0)
        self.log_tail = log_tail

    def texts(self, texts: pa.Array) -> pa.StructArray:
        """Of each text: tokens with the end, near known, near log10 counts, tail log10, far words and their counts, inputs without the end token."""
        n, (ws, cuts) = len(texts), words(texts)
        rank = pc.fill_null(pc.index_in(ws, self.near), -1).to_numpy()
        doc = np.repeat(np.arange(n), np.diff(cuts))
        at = np.flatnonzero(rank < 0)
        far = ws.take(pa.array(at)).dictionary_encode()
        code, kinds = far.indices.to_numpy(), max(1, len(far.dictionary))
        own = shapes(far.dictionary)[code]
        token, tail = self.token[rank], self.tail[rank]
        token[at], tail[at] = FREQUENT + own, -self.log_tail[own]
        met, tf = np.unique(doc[at] * kinds + code, return_counts=True)
        lists = pa.array(np.searchsorted(met, np.arange(n + 1) * kinds), pa.int32())
        columns = {
            "n_tokens": pa.array(np.diff(cuts) + 1),
            "n_near": pa.array(np.diff(cuts) - np.bincount(doc[at], minlength=n)),
            "near": pa.array(np.bincount(doc, weights=self.log[rank], minlength=n)),
            "tail": pa.array(np.bincount(doc, weights=tail, minlength=n)),
            "far": pa.ListArray.from_arrays(lists, far.dictionary.take(pa.array(met % kinds))),
            "tf": pa.ListArray.from_arrays(lists, pa.array(tf, pa.int32())),
            "tokens": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * cuts).astype(np.int32)), pa.py_buffer(token)]),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))


#: Class and place within it of each input.
_CLASS = np.concatenate((np.arange(FREQUENT) // SIZE, GROUPS + np.arange(SHAPES), [END_CLASS])).astype(np.uint8)
_WITHIN = np.concatenate((np.arange(FREQUENT) % SIZE, np.zeros(SHAPES + 1))).astype(np.uint8)


def coded(tokens: bytes):
    """``(inputs, classes, within)`` of an encoded text; the end token is last, and first as an input."""
    token = np.frombuffer(tokens, dtype="<u2")
    end = np.array([END_INPUT], dtype=token.dtype)
    target = np.concatenate((token, end))
    return np.concatenate((end, token)), _CLASS[target], _WITHIN[target]


def lanes(coded: list, n: int, tight: bool = True):
    """Documents laid end to end in up to ``n`` lanes of about equal length, in mixed order: arrays (steps, lanes) of input, class, within, document (-1: none) and starts. ``tight`` takes no more lanes than the longest document leaves room for."""
    sizes = [len(c[0]) for c in coded]
    n = max(1, min(n, len(coded), -(-sum(sizes) // max(sizes)) if tight else n))
    heap, own = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for d in sorted(range(len(coded)), key=lambda d: (-sizes[d], d)):
        at, k = heapq.heappop(heap)
        own[k].append(d)
        heapq.heappush(heap, (at + sizes[d], k))
    steps, rng = max(at for at, _ in heap), np.random.default_rng(3)
    inp, cls, within = (np.zeros((steps, n), dtype=np.int32) for _ in range(3))
    doc, start = np.full((steps, n), -1, dtype=np.int32), np.zeros((steps, n), dtype=bool)
    for k, docs in enumerate(own):
        at = 0
        for d in rng.permutation(docs) if docs else ():
            x, c, w = coded[d][:3]
            to = at + len(x)
            inp[at:to, k], cls[at:to, k], within[at:to, k], doc[at:to, k], start[at, k] = x, c, w, d, True
            at = to
    return inp, cls, within, doc, start


def _sigmoid_of_negated(x):
    """In place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sigmoid(x):
    """In place."""
    return _sigmoid_of_negated(np.negative(x, out=x))


def states(p: dict, inp, start, h, keep: bool = False):
    """Hidden states of a window from the carried state ``h``; with ``keep`` also what backpropagation needs: states before, gates, reset states and candidates."""
    steps, n = inp.shape
    out = np.empty((steps, n, HIDDEN), dtype=np.float32)
    dtype, both = p["x"].dtype, 2 * HIDDEN
    # the gates' weights negated, as a sigmoid takes exp(-x); one gate after the other, so that each lies in one piece
    x = p["x"] * np.repeat(np.array([-1, 1], dtype=dtype), (both, HIDDEN))
    u = np.ascontiguousarray(-p["u"].reshape(HIDDEN, 2, HIDDEN).transpose(1, 0, 2))
    kept = steps if keep else 1
    gates, cand = np.empty((kept, 2, n, HIDDEN), dtype=dtype), np.empty((kept, n, HIDDEN), dtype=dtype)
    was, reset = np.empty_like(out) if keep else None, np.empty((kept, n, HIDDEN), dtype=np.float32)
    met = np.empty((n, 3 * HIDDEN), dtype=dtype)
    met_gates, met_cand = met[:, :both].reshape(n, 2, HIDDEN).transpose(1, 0, 2), met[:, both:]
    begins, inp = start.any(axis=1), inp.astype(np.intp)
    for t in range(steps):
        if begins[t]:
            h = h * ~start[t][:, None]
        if keep:
            was[t] = h
        zr, c, rh, new = gates[t % kept], cand[t % kept], reset[t % kept], out[t]
        np.take(x, inp[t], axis=0, out=met, mode="clip")
        np.matmul(h, u, out=zr, casting="same_kind")
        zr += met_gates
        _sigmoid_of_negated(zr)
        np.multiply(zr[1], h, out=rh, casting="same_kind")
        np.matmul(rh, p["v"], out=c)
        c += met_cand
        np.tanh(c, out=c)
        np.subtract(c, h, out=new, casting="same_kind")
        new *= zr[0]
        new += h
        h = new
    return out, h, (was, gates, reset, cand) if keep else None


def _bound(w, b) -> float:
    """No logit of states within (-1, 1) is larger in size."""
    return float((np.abs(w).sum(axis=-2) + np.abs(b)).max())


#: Rows of logits made at a time, so that they stay in a core's cache.
_ROWS = 1024


def _by_class(p: dict, hs, cls, within, rows=None):
    """Rows of states (all, or those named) in order of their class: the order, states with a column of ones for the biases, classes, places within, and the cuts between the groups."""
    own = cls if rows is None else cls[rows]
    order = np.argsort(own.astype(np.uint8), kind="stable")
    if rows is not None:
        order = rows[order]
    one = np.ones((len(order), HIDDEN + 1), dtype=hs.dtype)
    one[:, :HIDDEN] = np.take(hs, order, axis=0)
    cls = cls[order]
    return order, one, cls, within[order], np.searchsorted(cls, np.arange(GROUPS + 1)).tolist()


def _with_biases(p: dict):
    return np.concatenate((p["c"], p["cb"][None])), np.concatenate((p["w"], p["wb"][:, None]), axis=1)


def _inner(one, w, cuts):
    """Logits within the groups of all rows in a group."""
    x = np.empty((cuts[-1], SIZE), dtype=np.result_type(one, w))
    for k in range(GROUPS):
        if cuts[k] < cuts[k + 1]:
            s = slice(cuts[k], cuts[k + 1])
            np.matmul(one[s], w[k], out=x[s])
    return x


def _picked(x, at, bound: float):
    """Log softmax of rows of logits at one place each; overwrites ``x``. With a small ``bound`` on all logits no row's own maximum is needed."""
    if bound >= 40:
        x -= x.max(axis=1, keepdims=True)
    out = x.ravel()[np.arange(0, x.size, x.shape[1]) + at]
    np.exp(x, out=x)
    return out - np.log(x @ np.ones(x.shape[1], dtype=x.dtype))


def _less_one(x, at, bound: float):
    """Gradients of negated log softmaxes at one place of each row of logits; overwrites ``x``."""
    if bound >= 40:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x *= np.reciprocal(x @ np.ones(x.shape[1], dtype=x.dtype))[:, None]
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at] -= 1
    return x


def log_probabilities(p: dict, hs, cls, within):
    """Natural log of each token's learned probability given flat states."""
    order, one, cls, within, cuts = _by_class(p, hs, cls, within)
    c, w = _with_biases(p)
    lp, bound, inner = np.empty(len(cls), dtype=hs.dtype), _bound(p["c"], p["cb"]), _bound(p["w"], p["wb"])
    for t in range(0, len(cls), _ROWS):
        s = slice(t, t + _ROWS)
        lp[s] = _picked(one[s] @ c, cls[s], bound)
    if cuts[-1]:
        lp[: cuts[-1]] += _picked(_inner(one, w, cuts), within[: cuts[-1]], inner)
    out = np.empty_like(lp)
    out[order] = lp
    return out


def _output_gradients(p: dict, hs, cls, within, rows):
    """Gradients of the negated sum of log probabilities of ``rows``: by states (zero for other rows), and by the output weights."""
    order, one, cls, within, cuts = _by_class(p, hs, cls, within, rows)
    c, w = _with_biases(p)
    ct, wt = np.ascontiguousarray(p["c"].T), np.ascontiguousarray(p["w"].transpose(0, 2, 1))
    dh, gc, gw, bound = np.empty((len(cls), HIDDEN), dtype=c.dtype), np.zeros_like(c), np.zeros_like(w), _bound(p["c"], p["cb"])
    for t in range(0, len(cls), _ROWS):
        s = slice(t, t + _ROWS)
        d = _less_one(one[s] @ c, cls[s], bound)
        gc += one[s].T @ d
        np.matmul(d, ct, out=dh[s])
    d = _less_one(_inner(one, w, cuts), within[: cuts[-1]], _bound(p["w"], p["wb"]))
    for k in range(GROUPS):
        if cuts[k] < cuts[k + 1]:
            s = slice(cuts[k], cuts[k + 1])
            np.matmul(one[s].T, d[s], out=gw[k])
            dh[s] += d[s] @ wt[k]
    out = np.zeros((len(hs), HIDDEN), dtype=dh.dtype)
    out[order] = dh
    return out, {"c": gc[:-1], "cb": gc[-1], "w": gw[:, :-1], "wb": gw[:, -1]}


#: A place with more rows than this is summed by itself.
_FEW = 6


def _summed(rows, at, n: int):
    """Sums of the rows of each of ``n`` places; rows of one place lie together."""
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ids, count = at[first], np.diff(np.append(first, len(at)))
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    many = count > _FEW
    for i, a, k in zip(ids[many].tolist(), first[many].tolist(), count[many].tolist(), strict=True):
        np.add.reduce(rows[a : a + k], axis=0, out=out[i])
    ids, first, count = ids[~many], first[~many], count[~many]
    for k in range(_FEW):  # the first rows of each place, then the second ones
        left = np.flatnonzero(count > k)
        ids, first, count = ids[left], first[left], count[left]
        out[ids] += np.take(rows, first + k, axis=0)
    return out


def gradients(p: dict, inp, cls, within, doc, start, h):
    """Gradients of the mean negative log-likelihood of one window, cut off at its start; and the state carried on."""
    hs, carried, (was, gates, reset, cand) = states(p, inp, start, h, keep=True)
    steps, n = inp.shape
    rows = np.flatnonzero(doc >= 0)
    total = max(1, len(rows))
    dhs, g = _output_gradients(p, hs.reshape(-1, HIDDEN), cls.ravel(), within.ravel(), rows)
    dhs = dhs.reshape(steps, n, HIDDEN)
    dh, begins = np.zeros((n, HIDDEN), dtype=np.float32), start.any(axis=1)
    ut, vt = np.ascontiguousarray(p["u"].reshape(HIDDEN, 2, HIDDEN).transpose(1, 2, 0)), np.ascontiguousarray(p["v"].T)
    rest, by, drh = np.empty_like(gates[0]), np.empty_like(cand[0]), np.empty_like(cand[0])
    for t in range(steps - 1, -1, -1):
        # gates and candidates give way to their gradients, so that less memory is gone through
        both, c = gates[t], cand[t]
        z, r = both
        dh += dhs[t]
        np.subtract(1, both, out=rest)
        np.multiply(c, c, out=by)
        np.subtract(1, by, out=by)
        by *= z
        np.multiply(dh, by, out=c)
        np.matmul(c, vt, out=drh)
        np.subtract(hs[t], was[t], out=by)  # z times what the candidate differs by
        by *= rest[0]
        np.multiply(dh, by, out=z)
        np.multiply(reset[t], rest[1], out=by)
        by *= drh
        drh *= r
        r[:] = by
        for part in np.matmul(both, ut):
            drh += part
        dh *= rest[0]
        dh += drh
        if begins[t]:
            dh *= ~start[t][:, None]
    # tokens in order of their input, so that the rows of one input lie together
    at = inp.ravel()
    order = np.argsort(at.astype(np.uint16), kind="stable")
    z = order + order // n * n  # the row of a token's first gate
    take = lambda x, rows: np.take(x.reshape(-1, HIDDEN), rows, axis=0)
    dx = np.concatenate((take(gates, z), take(gates, z + n), take(cand, order)), axis=1)
    g["u"], g["v"] = take(was, order).T @ dx[:, : 2 * HIDDEN], take(reset, order).T @ dx[:, 2 * HIDDEN :]
    g["x"] = _summed(dx, at[order], INPUTS)
    return {k: v / total for k, v in g.items()}, carried, float(total)


#: Weights that are moved at a time.
_BLOCK = 16_384


def train(flat: np.ndarray, coded: list, rate: float = RATE, least: int = LEAST_UPDATES) -> tuple[np.ndarray, int]:
    """Weights after one round over the coded texts by truncated backpropagation with Adam, and the tokens seen.

    A window with few live lanes takes a smaller step, the rate falls to zero
    over the round, and the mean of the round's second half is returned.
    """
    flat = flat.astype(np.float32).copy()
    p = unpack(flat)
    inp, cls, within, doc, start = lanes(coded, LANES, tight=False)
    live = [int((doc[t : t + STEPS] >= 0).sum()) for t in range(0, len(inp), STEPS)]
    passes = max(1, -(-least // len(live)))
    m, v, mean = (np.zeros_like(flat) for _ in range(3))
    updates, kept, total = 0, 0, passes * len(live)
    for _ in range(passes):
        h = np.zeros((inp.shape[1], HIDDEN), dtype=np.float32)
        for k, t in enumerate(range(0, len(inp), STEPS)):
            s = slice(t, t + STEPS)
            on = np.flatnonzero((doc[s] >= 0).any(axis=0))  # lanes that have ended cost nothing
            g, h[on], _ = gradients(p, *(x[s][:, on] for x in (inp, cls, within, doc, start)), h[on])
            step = np.concatenate([g[name].ravel() for name, _ in SHAPES_OF])
            clip = min(1.0, 1.0 / (float(np.linalg.norm(step)) + 1e-9))
            updates += 1
            # both means without their factors 0.1 and 0.001, which the size of the step makes up for
            size = (0.001 / (1 - 0.999**updates)) ** 0.5
            now = 0.1 * rate * (1 - (updates - 1) / total) * live[k] / max(live) / (1 - 0.9**updates) / size
            for at in range(0, len(flat), _BLOCK):  # in place and by blocks, as the weights of several tasks share a cache
                b = slice(at, at + _BLOCK)
                gb, mb, vb, fb = step[b], m[b], v[b], flat[b]
                gb *= clip
                mb *= 0.9
                mb += gb
                vb *= 0.999
                gb *= gb
                vb += gb
                np.sqrt(vb, out=gb)
                gb += EPS / size
                np.divide(mb, gb, out=gb)
                gb *= now
                fb -= gb
                if 2 * updates > total:
                    mean[b] += fb
            if 2 * updates > total:
                kept += 1
    return mean / kept, sum(live)


def counted(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all words of ``texts (text)``, counted in each batch before they are dealt out."""
    bound_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.value_counts(words(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([n.field("values"), n.field("counts")], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, n_docs: int) -> dict:
    """Totals, the nearest words and the statistics of the classes; all of bounded size but for the totals' source."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(bucket("n").alias("b")).count().collect()), reverse=True)  # some hundred rows
    least, upto = None, 0
    for b, k in sizes:  # whole buckets of counts, from the most frequent down
        upto += k
        if upto > NEAR:
            break
        least = b
    top = counts.filter(F.lit(False) if least is None else F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])  # NEAR rows at most
    near, count = list(top["word"]), top["n"].to_numpy(dtype=np.float64)
    per = {r[0]: (r[1], r[2]) for r in counts.groupBy(shape_column("word").alias("s")).agg(F.sum("n"), F.count(F.lit(1))).collect()}  # SHAPES rows
    in_class, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for s, (a, b) in per.items():
        in_class[s], kinds[s] = a, b
    for w, c in zip(near[:FREQUENT], count[:FREQUENT], strict=True):
        in_class[shape(w)] -= c
        kinds[shape(w)] -= 1
    frequent = np.zeros(FREQUENT)
    frequent[: min(FREQUENT, len(count))] = count[:FREQUENT]
    groups = frequent.reshape(GROUPS, SIZE)
    mass = np.concatenate((groups.sum(axis=1), in_class + 0.1 * (kinds + 1), [n_docs])) + 0.1
    return {
        "total": int(n) + n_docs, "distinct": int(v) + (n_docs > 0), "end": n_docs, "near": near, "near_count": count,
        "log_tail": np.log10(in_class + 0.1 * (kinds + 1)),
        "class_bias": np.log(mass / mass.sum()), "word_bias": np.log((groups + 0.1) / (groups + 0.1).sum(axis=1, keepdims=True)),
    }


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, vocab) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(vocab.value)
    return _ENCODERS[name]


def _round(weights):
    """Trains on the encoded texts of one shard, which holds about ``SHARD`` tokens."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        new, tokens = train(weights.value, [coded(x) for x in sorted(pdf["tokens"])])
        return pd.DataFrame({"weights": [new], "tokens": [tokens]})

    return one


def dealt(texts: DataFrame, shards: int) -> DataFrame:
    """``(tokens, round, shard)``: each row of ``texts (tokens)`` once. Rows are dealt by number, so copies of a text spread."""
    row = F.monotonically_increasing_id()
    part = lambda salt, n: F.pmod(F.xxhash64("__row", F.lit(salt)), F.lit(n)).cast("int")
    return texts.select("tokens", row.alias("__row")).select("tokens", part("round", ROUNDS).alias("round"), part("shard", shards).alias("shard"))


def fitted(texts: DataFrame, first: np.ndarray) -> np.ndarray:
    """Weights trained on all ``texts (tokens)``, encoded, each in one round: rounds of parallel shards whose weights are averaged by tokens."""
    spark = texts.sparkSession
    n, tokens = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("tokens") / 2 + 1), F.lit(0)).cast("long")).first()
    if not n:
        return first
    parts = stored(dealt(texts, max(LEAST_SHARDS, -(-tokens // SHARD))))
    flat = first
    for k in range(ROUNDS):
        each = parts.filter(F.col("round") == k).groupBy("shard").applyInPandas(_round(spark.sparkContext.broadcast(flat)), "weights array<float>, tokens long")
        mean = each.select("tokens", F.posexplode("weights")).groupBy("pos").agg((F.sum(F.col("col") * F.col("tokens")) / F.sum("tokens")).alias("w"))
        rows = mean.toPandas()  # one row for each weight of the model
        if len(rows):
            flat = rows.sort_values("pos")["w"].to_numpy(dtype=np.float32)
    return flat


def encoded(docs: DataFrame, vocab) -> DataFrame:
    """``docs`` with ``e (n_tokens, n_near, near, tail, far, tf, tokens)`` in place of ``text``."""
    name = uuid.uuid4().hex

    @F.arrow_udf("n_tokens long, n_near long, near double, tail double, far array<string>, tf array<int>, tokens binary")
    def encode(texts: pa.Array) -> pa.Array:
        return _encoder(name, vocab).texts(texts)

    return docs.select(*(c for c in docs.columns if c != "text"), encode("text").alias("e"))


def log10_learned(weights):
    """The learned part of the log10 probability of encoded texts, as a column function."""

    @F.pandas_udf("double")
    def score(tokens: pd.Series) -> pd.Series:
        p, texts = unpack(weights.value), [coded(x) for x in tokens]
        if not texts:
            return pd.Series([], dtype=float)
        inp, cls, within, doc, start = lanes(texts, 256)
        own, h = np.zeros(len(texts)), np.zeros((inp.shape[1], HIDDEN), dtype=np.float32)
        for t in range(0, len(inp), 64):
            s = slice(t, t + 64)
            hs, h, _ = states(p, inp[s], start[s], h)
            mask = (doc[s] >= 0).ravel()
            lp = log_probabilities(p, hs.reshape(-1, HIDDEN)[mask], cls[s].ravel()[mask], within[s].ravel()[mask])
            own += np.bincount(doc[s].ravel()[mask], weights=lp.astype(np.float64), minlength=len(texts))
        return pd.Series(own / np.log(10))

    return score


def likelihood(docs: DataFrame, learns: Column) -> DataFrame:
    """``docs`` without ``text`` but with token counts and the log10 probability of each whole text, under models of the rows where ``learns`` is true.

    Null texts are empty: one end token. Rows with equal ids or texts are scored
    each by itself, and learned from each. Without rows to learn from every
    token is unknown. Columns other than ``text`` pass through unread; those
    named as added ones give way. Each text is encoded once, for learning and
    for scoring. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark, "8m")
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rest = [c for c in docs.columns if c not in (*added, "text")]
    own = F.struct(*rest) if rest else F.lit(None)
    rows = docs.select(own.alias("__own"), F.coalesce(learns, F.lit(False)).alias("__learns"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(counted(rows.filter("__learns").select("text")))
    vocab = spark.sparkContext.broadcast(vocabulary(counts, rows.filter("__learns").count()))
    part = stored(encoded(rows, vocab).select(F.monotonically_increasing_id().alias("__rid"), "__own", "__learns", "e.*"))
    flat = fitted(part.filter("__learns").select("tokens"), initial(vocab.value))

    total, distinct, end = (vocab.value[k] for k in ("total", "distinct", "end"))
    log_z = float(np.log10(total + 0.1 * (distinct + 1)))
    far = part.select("__rid", F.explode(F.arrays_zip("far", "tf")).alias("f")).select("__rid", F.col("f.far").alias("word"), "f.tf")
    met = far.join(counts, "word", "left").groupBy("__rid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("far_log"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("far_known"))
    learned = log10_learned(spark.sparkContext.broadcast(flat))
    out = part.select("__rid", "__own", "n_tokens", "n_near", "near", "tail", learned("tokens").alias("learned")).join(met, "__rid", "left")
    log = F.coalesce("far_log", F.lit(0.0))
    return out.select(
        *(F.col("__own")[c].alias(c) for c in rest),
        "n_tokens",
        (F.col("n_near") + F.coalesce("far_known", F.lit(0)) + F.lit(int(end > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("near") + log + F.lit(float(np.log10(end + 0.1))) - F.col("n_tokens") * F.lit(log_z)).alias("base_score"),
        (F.col("learned") + F.col("tail") + log).alias("score"),
    )


def held_out(folds: int = 10):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    return likelihood(docs, ~F.col("held_out"))


QUERIES = {"op6_lm": (op6, None)}

"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried across windows.

Tokens are integers from 0 to V-1, the word tokens first, by frequency, then the tail classes. Word tokens belong to
classes of CLASS_WORDS neighbours in frequency; a tail class is a class without words of its own. A token's probability is
that of its class times, for a word, that of the word within the class. Texts run in lanes: each lane reads its texts one
after the other, and the state is reset where a text begins.
"""

from __future__ import annotations

import numpy as np

from .worker import keep_freed

CLASS_WORDS = 128
HIDDEN = 24
LANES_TRAINING, LANES_SCORING = 256, 512
WINDOW_TRAINING, WINDOW_SCORING = 16, 32
#: Rows of a matrix product, and of a softmax: what they need then stays in the near caches.
BLOCK = 512
#: Rows of a name up to which they are added one by one.
FEW_ROWS = 16
#: Gradients are means over a full window, so the first squares are small enough for a step to grow with its tokens.
RATE, START_SQUARE = 0.08, 6e-5


def sizes(words: int, tails: int) -> tuple[int, int]:
    """Word classes and all classes."""
    n = -(-words // CLASS_WORDS)
    return n, n + tails


def shapes(words: int, tails: int) -> list[tuple[str, tuple[int, ...]]]:
    _, c = sizes(words, tails)
    return [("x", (words + tails + 1, 3 * HIDDEN)), ("u", (HIDDEN, 3 * HIDDEN)), ("wc", (HIDDEN, c)), ("bc", (c,)), ("ww", (words, HIDDEN)), ("bw", (words,))]


def start(counts: np.ndarray, tails: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; biases are log frequencies, so the untrained model is the class-factored unigram model. counts: of the words and the tail classes."""
    words = len(counts) - tails
    n, c = sizes(words, tails)
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(words, tails)}
    p["ww"] *= 0.1
    p["wc"] *= 0.1
    by_class = np.concatenate([np.add.reduceat(counts[:words], np.arange(0, words, CLASS_WORDS)) if words else np.zeros(0), counts[words:]]).astype(float)
    p["bc"] = np.log((by_class + 1) / (by_class + 1).sum()).astype(np.float32)
    first = np.arange(words) // CLASS_WORDS * CLASS_WORDS  # the most frequent word of each class
    p["bw"] = np.log((counts[:words] + 1.0) / (counts[first] + 1.0)).astype(np.float32)
    return p


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in ("x", "u", "wc", "bc", "ww", "bw")]).astype(np.float32)


def unpack(flat: np.ndarray, words: int, tails: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(words, tails):
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


def lanes(offsets: np.ndarray, count: int) -> list[list[int]]:
    """Texts dealt to lanes, longest first to the shortest lane; lanes come longest first."""
    import heapq

    n = np.diff(offsets)
    heap = [(0, i) for i in range(min(count, max(1, int((n > 0).sum()))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-n, kind="stable"):
        if n[d]:
            total, i = heapq.heappop(heap)
            out[i].append(int(d))
            heapq.heappush(heap, (total + int(n[d]), i))
    return sorted((x for x in out if x), key=lambda ds: -sum(int(n[d]) for d in ds))


def laid_out(ids: np.ndarray, offsets: np.ndarray, count: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per step and lane: the token before (``begin`` at a text's start), the token, its text, and each lane's length."""
    order = lanes(offsets, count)
    length = np.array([sum(int(offsets[d + 1] - offsets[d]) for d in ds) for ds in order], np.int64)
    steps = int(length.max(initial=0))
    before, token, text = (np.zeros((steps, len(order)), np.int32) for _ in range(3))
    for j, ds in enumerate(order):
        t = 0
        for d in ds:
            a, b = int(offsets[d]), int(offsets[d + 1])
            before[t, j] = begin
            before[t + 1 : t + b - a, j] = ids[a : b - 1]
            token[t : t + b - a, j] = ids[a:b]
            text[t : t + b - a, j] = d
            t += b - a
    return before, token, text, length


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; a tangent takes less time than an exponential and a reciprocal."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _odds(x: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray]:
    """Logits to their exponentials in place, less the row's sum at the flat places ``own``: divided by that sum, the gradient.

    Returns the rows' negative log probabilities, summed, and the sums of exponentials. These need no shift: states are
    within 1, and start() centres the biases. Rows are not divided here, as a row of weights or states is far shorter.
    """
    flat = x.ravel()
    pick = flat.take(own)
    np.exp(x, out=x)
    s = x @ np.ones(x.shape[1], x.dtype)
    flat[own] -= s
    return float(np.log(s).sum() - pick.sum()), s


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole blocks of rows, and the rows that are left. Products of a block take little more than half the time of one over all rows."""
    n = len(x) // BLOCK * BLOCK
    return x[:n].reshape(-1, BLOCK, x.shape[1]), x[n:]


def _over_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y"""
    (x, more_x), (y, more_y) = _blocks(x), _blocks(y)
    out = more_x.T @ more_y
    if len(x):
        out += np.matmul(x.transpose(0, 2, 1), y).sum(axis=0)
    return out


def _summed(names: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each name once, in any order, and the sums of its rows. Names are 0 to ``most``.

    The names of many rows by products with ones; of all others the first rows, then the second ones and so on: the more
    rows a name has the further ahead it comes, so those that have a next row are a run.
    """
    order = np.argsort(_short(names, most), kind="stable")
    names = names.take(order)
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    count = np.append(first[1:], len(names)) - first
    by = np.argsort(_short(len(names) - count, len(names)), kind="stable")
    first, count = first.take(by), count.take(by)
    have = np.searchsorted(-count, -np.arange(FEW_ROWS + 1))  # names of more than so many rows
    many, ones, out = int(have[-1]), np.ones(int(count[0]), x.dtype), np.empty((len(first), x.shape[1]), x.dtype)
    for i, (a, n) in enumerate(zip(first[:many].tolist(), count[:many].tolist())):
        np.matmul(ones[:n], x.take(order[a : a + n], axis=0), out=out[i])
    x.take(order.take(first[many:]), axis=0, out=out[many:], mode="clip")
    for j in range(1, FEW_ROWS):
        if have[j] <= many:
            break
        out[many : have[j]] += x.take(order.take(first[many : have[j]] + j), axis=0)
    return names.take(first), out


def _with_ones(x: np.ndarray) -> np.ndarray:
    """A last column of ones, so that a product adds biases, and the transposed one sums over rows."""
    out = np.ones((*x.shape[:-1], x.shape[-1] + 1), x.dtype)
    out[..., :-1] = x
    return out


def forward(p: dict[str, np.ndarray], before: np.ndarray, begin: int, h: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
    """States after each step of a window (steps, lanes, HIDDEN), the last state, and what backpropagation needs.

    Inside, lanes are the last axis: each gate is then one run of memory.
    """
    steps, b = before.shape
    k = HIDDEN
    u = np.ascontiguousarray(p["u"].T)
    out, h, old = np.empty((steps, k, b), np.float32), np.ascontiguousarray(h.T), []
    gates = np.empty((steps if keep else 1, 3 * k, b), u.dtype)
    less, inner = (np.empty((steps, k, b), u.dtype), np.empty((steps, k, b), u.dtype)) if keep else (None, None)
    new = before == begin
    some = new.any(axis=1)
    g, short, rows = np.empty((3 * k, b), u.dtype), np.empty((k, b), u.dtype), np.empty((b, 3 * k), u.dtype)
    for t in range(steps):
        if some[t]:
            h = h * ~new[t]
        x, nxt = gates[t if keep else 0], out[t]
        p["x"].take(before[t], axis=0, out=rows, mode="clip")  # all are within; the default mode copies
        x[...] = rows.T
        np.matmul(u, h, out=g)
        zr, n = x[: 2 * k], x[2 * k :]
        zr += g[: 2 * k]
        _sigmoid(zr)
        np.multiply(zr[k:], g[2 * k :], out=short)
        n += short
        np.tanh(n, out=n)
        if keep:
            old.append(h)
            inner[t] = g[2 * k :]
        rest = np.subtract(h, n, out=less[t] if keep else short)
        np.multiply(rest, zr[:k], out=nxt)
        nxt += n
        h = nxt
    return out.transpose(0, 2, 1), h.T, (old, less, gates, inner, new, some)


def _short(x: np.ndarray, most: int) -> np.ndarray:
    """Keys of two bytes where they fit: these are sorted by radix."""
    return x.astype(np.uint16) if most < 1 << 16 else x


def by_class(token: np.ndarray, words: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of word tokens in the order of their classes, and (class, first, end) of each class there."""
    at = np.flatnonzero(token < words)
    cls = token[at] // CLASS_WORDS
    order = np.argsort(_short(cls, words), kind="stable")
    at, cls = at[order], cls[order]
    edge = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1], [True]))) if len(cls) else np.zeros(1, int)
    return at, [(int(cls[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:])]


def token_class(token: np.ndarray, words: int) -> np.ndarray:
    return np.where(token < words, token // CLASS_WORDS, token - words + -(-words // CLASS_WORDS))


def log_probabilities(p: dict[str, np.ndarray], states: np.ndarray, token: np.ndarray, words: int) -> np.ndarray:
    """Natural log of each token's probability given the state that predicts it."""
    hs = _with_ones(states)
    wc, cls = np.vstack([p["wc"], p["bc"]]), token_class(token, words)
    out, logits, each = np.empty(len(token)), np.empty((min(BLOCK, len(token)), wc.shape[1]), hs.dtype), np.arange(BLOCK)
    for a in range(0, len(token), BLOCK):
        x = hs[a : a + BLOCK]
        s = logits[: len(x)]
        np.matmul(x, wc, out=s)
        own = s[each[: len(x)], cls[a : a + BLOCK]]
        np.exp(s, out=s)
        out[a : a + BLOCK] = own - np.log(s @ np.ones(s.shape[1], s.dtype))
    at, groups = by_class(token, words)
    hs, tok, ww = hs.take(at, axis=0), token.take(at), np.column_stack([p["ww"], p["bw"]])
    within = np.empty(len(at), hs.dtype)
    for c, a, b in groups:
        lo, hi = c * CLASS_WORDS, min(words, (c + 1) * CLASS_WORDS)
        x = hs[a:b] @ ww[lo:hi].T
        own = x[np.arange(b - a), tok[a:b] - lo]
        np.exp(x, out=x)
        within[a:b] = own - np.log(x @ np.ones(hi - lo, x.dtype))
    out[at] += within
    return out


def score(p: dict[str, np.ndarray], ids: np.ndarray, offsets: np.ndarray, words: int, tails: int) -> np.ndarray:
    """Natural log probability of each text; the state runs on from window to window until the text ends."""
    keep_freed()
    begin = words + tails
    total = np.zeros(len(offsets) - 1)
    before, token, text, length = laid_out(ids, offsets, LANES_SCORING, begin)
    if not len(length):
        return total
    h = np.zeros((len(length), HIDDEN), np.float32)
    e = 0
    while e < len(before):
        s, active = e, int((length > e).sum())
        e = min(s + WINDOW_SCORING * LANES_SCORING // min(active, LANES_SCORING), len(before))  # the fewer lanes, the more steps at once
        states, h, _ = forward(p, before[s:e, :active], begin, h[:active], False)
        valid = np.arange(s, e)[:, None] < length[None, :active]
        tok = token[s:e, :active][valid]
        lp = log_probabilities(p, states[valid], tok, words)
        total += np.bincount(text[s:e, :active][valid], weights=lp, minlength=len(total))
    return total


class Trainer:
    """Adagrad over windows of truncated backpropagation."""

    def __init__(self, p: dict[str, np.ndarray], words: int, tails: int):
        self.p, self.words, self.tails = p, words, tails
        self.square = {k: np.full(v.shape, START_SQUARE, np.float32) for k, v in p.items()}
        self.tokens = 0

    def _step(self, k: str, g: np.ndarray, rows=None) -> None:
        some = rows is not None and not isinstance(rows, slice)
        if some:
            w, s = self.p[k].take(rows, axis=0), self.square[k].take(rows, axis=0)
        else:
            w, s = (self.p[k], self.square[k]) if rows is None else (self.p[k][rows], self.square[k][rows])
        move = g * g
        s += move
        np.sqrt(s, out=move)
        np.divide(g, move, out=move)
        move *= RATE
        w -= move
        if some:
            self.square[k][rows], self.p[k][rows] = s, w

    def learn(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        keep_freed()
        begin = self.words + self.tails
        before, token, _, length = laid_out(ids, offsets, LANES_TRAINING, begin)
        if not len(length):
            return
        h = np.zeros((len(length), HIDDEN), np.float32)
        for s in range(0, len(before), WINDOW_TRAINING):
            e = min(s + WINDOW_TRAINING, len(before))
            active = int((length > s).sum())
            valid = np.arange(s, e)[:, None] < length[None, :active]
            h = self._window(before[s:e, :active], token[s:e, :active], valid, h[:active])
        self.tokens += len(ids)

    def gradients(self, before: np.ndarray, token: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of a window's negative log probability over the tokens of a full window; rows of x and ww come with their places.

        So a window in which few lanes are left moves the weights little.
        """
        p, words, k = self.p, self.words, HIDDEN
        begin = words + self.tails
        states, last, (old, less, gates, inner, new, some) = forward(p, before, begin, h, True)
        whole = valid.all()
        hs, tok = _with_ones(states if whole else states[valid]).reshape(-1, k + 1), token[valid]
        m = float(WINDOW_TRAINING * LANES_TRAINING)
        wc, back_wc = np.vstack([p["wc"], p["bc"]]), p["wc"].T
        cls, loss, gc, dh = token_class(tok, words), 0.0, np.zeros_like(wc), np.empty((len(tok), k), wc.dtype)
        soft, each = np.empty((min(BLOCK, len(tok)), wc.shape[1]), wc.dtype), np.arange(len(tok))
        for a in range(0, len(tok), BLOCK):
            x, d = hs[a : a + BLOCK], dh[a : a + BLOCK]
            s = soft[: len(x)]
            np.matmul(x, wc, out=s)
            more, total = _odds(s, each[: len(x)] * s.shape[1] + cls[a : a + BLOCK])
            loss += more
            share = (1 / m / total)[:, None]
            gc += (x * share).T @ s
            np.matmul(s, back_wc, out=d)
            d *= share
        grads: dict = {"wc": gc[:-1], "bc": gc[-1]}
        at, groups = by_class(tok, words)
        hs, tok = hs.take(at, axis=0), tok.take(at)
        # the words of the window's classes; all others have no gradient, and a step leaves them as they are
        own, n_own = slice(0, words), words
        if len(groups) * CLASS_WORDS < words:
            own = np.add.outer([c * CLASS_WORDS for c, _, _ in groups], np.arange(CLASS_WORDS, dtype=np.int64)).ravel().astype(np.int64)
            own = own[own < words]
            n_own = len(own)
        ww = np.empty((len(groups) * CLASS_WORDS, k + 1), dh.dtype)
        ww[:n_own, :-1], ww[:n_own, -1] = p["ww"][own], p["bw"][own]
        ww[n_own:, :-1], ww[n_own:, -1] = 0, -np.inf  # the last class is filled up with words of no probability
        ww = ww.reshape(-1, CLASS_WORDS, k + 1)
        back, gw = np.empty((len(at), k), dh.dtype), np.empty((len(groups), k + 1, CLASS_WORDS), dh.dtype)
        soft, i = np.empty((max([BLOCK, *(b - a for _, a, b in groups)]), CLASS_WORDS), dh.dtype), 0
        while i < len(groups):  # as many classes as have a block's rows, one at least
            first, lo = i, groups[i][1]
            while i < len(groups) and (i == first or groups[i][2] - lo <= BLOCK):
                i += 1
            hi = groups[i - 1][2]
            s, x, d = soft[: hi - lo], hs[lo:hi], back[lo:hi]
            for j in range(first, i):
                _, a, b = groups[j]
                np.matmul(hs[a:b], ww[j].T, out=s[a - lo : b - lo])
            more, total = _odds(s, each[: hi - lo] * CLASS_WORDS + tok[lo:hi] % CLASS_WORDS)
            loss += more
            share = (1 / m / total)[:, None]
            x *= share
            for j in range(first, i):
                _, a, b = groups[j]
                np.matmul(s[a - lo : b - lo], ww[j, :, :-1], out=back[a:b])
                gw[j] = _over_rows(hs[a:b], s[a - lo : b - lo]) if b - a > BLOCK else hs[a:b].T @ s[a - lo : b - lo]
            d *= share
        grads["words"] = [(own, np.ascontiguousarray(gw[:, :-1].transpose(0, 2, 1)).reshape(-1, k)[:n_own], gw[:, -1].ravel()[:n_own])]
        back += dh.take(at, axis=0)
        dh[at] = back
        if whole:
            full = np.ascontiguousarray(dh.reshape(*before.shape, k).transpose(0, 2, 1))
        else:
            full = np.zeros(less.shape, dh.dtype)
            full.transpose(0, 2, 1)[valid] = dh
        z, r, n = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
        rest = 1 - z
        less *= z
        less *= rest  # to z
        to_n = n * n
        np.subtract(1, to_n, out=to_n)
        to_n *= rest
        np.subtract(1, r, out=rest)
        rest *= r
        inner *= rest  # to r
        dx, dg = np.empty((*before.shape, 3 * k), dh.dtype), np.empty((3 * k, before.shape[1] + 8), dh.dtype)[:, :-8]  # rows apart by no power of two: it is read by columns
        dz, dr, dn = dg[:k], dg[k : 2 * k], dg[2 * k :]
        du, carry, through = np.zeros_like(p["u"]), np.zeros_like(inner[0]), np.empty_like(inner[0])
        for t in range(len(before) - 1, -1, -1):
            d = full[t]
            d += carry
            np.multiply(less[t], d, out=dz)
            np.multiply(to_n[t], d, out=dn)
            np.multiply(inner[t], dn, out=dr)
            dx[t] = dg.T
            dn *= r[t]
            du += old[t] @ dg.T
            np.matmul(p["u"], dg, out=carry)
            np.multiply(d, z[t], out=through)
            carry += through
            if some[t]:
                carry[:, new[t]] = 0
        grads["u"] = du
        grads["x"] = _summed(before.ravel(), dx.reshape(-1, 3 * k), begin)
        return grads, last, loss / m

    def _window(self, before: np.ndarray, token: np.ndarray, valid: np.ndarray, h: np.ndarray) -> np.ndarray:
        g, last, _ = self.gradients(before, token, valid, h)
        for k in ("wc", "bc", "u"):
            self._step(k, np.clip(g[k], -1, 1))
        rows, gx = g["x"]
        self._step("x", gx, rows)
        for part, gw, gb in g["words"]:
            self._step("ww", gw, part)
            self._step("bw", gb, part)
        return last

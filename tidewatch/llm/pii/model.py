"""The tagger: characters, a bidirectional LSTM over windows, and a CRF over whole texts. Training and use are plain numpy.

Tags are O and, for each kind, B (the first character of a span) and I (the others).
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "person_name")
TAGS = 1 + 2 * len(KINDS)
WINDOW, OVERLAP = 384, 64
#: Buckets of a script's characters: first, last, number.
_BLOCKS = [(0xAC00, 0xD7A3, 97), (0x3040, 0x309F, 16), (0x30A0, 0x30FF, 16), (0x3400, 0x9FFF, 64), (0x0E00, 0x0E7F, 32)]
VOCABULARY = 128 + sum(n for *_, n in _BLOCKS) + 8


@functools.cache
def table() -> np.ndarray:
    """The class of each code point: ASCII itself; of other Latin letters their base; wide and other forms as the ASCII character they stand for; buckets for other scripts."""
    out = np.full(0x110000, VOCABULARY - 1, np.uint16)
    out[:128] = np.arange(128)
    out[[9, 11, 12]], out[13] = 32, 10
    at = 128
    for a, b, n in _BLOCKS:
        out[a : b + 1] = at + np.arange(b + 1 - a) % n
        at += n
    for c in [*range(0x80, 0x0E00), *range(0x1E00, 0x2E80), *range(0x3000, 0x3040), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)]:
        plain = unicodedata.normalize("NFKD", chr(c))[:1]
        kind = unicodedata.category(chr(c))
        if plain and ord(plain) < 128:
            out[c] = ord(plain)
        elif kind in ("Pd",) or c == 0x2212:
            out[c] = 45
        elif kind in ("Pi", "Pf") or c in (0x300C, 0x300D):
            out[c] = 34
        elif kind == "Zs":
            out[c] = 32
        elif c == 0x3002:
            out[c] = 46
        elif c == 0x3001:
            out[c] = 44
        else:
            out[c] = VOCABULARY - 2 - "LMNPSC".index(kind[0]) % 6 if kind[0] in "LMNPSC" else VOCABULARY - 1
    return out


def classes(text: str) -> np.ndarray:
    return table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def fresh(rng: np.random.Generator, hidden: int = 32, width: int = 24) -> dict[str, np.ndarray]:
    """Parameters before training; the first axis of w, u and b is the direction. Gates: input, forget, output, new."""
    def r(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    b = np.zeros((2, 4 * hidden), np.float32)
    b[:, hidden : 2 * hidden] = 1
    return {"e": r(VOCABULARY, width, scale=0.3), "w": r(2, width, 4 * hidden, scale=width**-0.5), "u": r(2, hidden, 4 * hidden, scale=hidden**-0.5), "b": b, "o": r(2 * hidden, TAGS, scale=(2 * hidden) ** -0.5), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32), "f": np.zeros(TAGS, np.float32)}


def both_ways(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (2, T, B) that read each window forward and, within its length, backward; and the mask (T, B)."""
    t = np.arange(ids.shape[0])[:, None]
    back = np.where(t < lengths, lengths - 1 - t, t)
    return np.stack([np.broadcast_to(t, back.shape), back]), t < lengths


def step(z: np.ndarray, c: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gates, new cells, their tanh, new states. z is overwritten by the gates; the sigmoid is a tanh of half the value."""
    z[..., : 3 * h] *= 0.5
    np.tanh(z, out=z)
    gate = z[..., : 3 * h]
    gate += 1
    gate *= 0.5
    new = z[..., h : 2 * h] * c
    new += z[..., :h] * z[..., 3 * h :]
    squashed = np.tanh(new)
    return z, new, squashed, z[..., 2 * h : 3 * h] * squashed


def tanh(x: np.ndarray, s: np.ndarray, d: np.ndarray) -> None:
    """The hyperbolic tangent in place, within 1.1e-4, by a quotient of polynomials; s and d are room for it. numpy's own takes three times as long."""
    np.clip(x, -4.97, 4.97, out=x)
    np.multiply(x, x, out=s)
    np.multiply(s, 28, out=d)
    d += 3150
    d *= s
    d += 62370
    d *= s
    d += 135135
    x /= d
    np.add(s, 378, out=d)
    d *= s
    d += 17325
    d *= s
    d += 135135
    x *= d


def inputs(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters as emissions uses them: x is what each character class adds to the gates, of both directions one after the other.

    A sigmoid is (1 + tanh of half the value) / 2. The halves are put into the parameters, so states and cells are kept doubled.
    """
    H = p["u"].shape[1]
    half = np.ones(4 * H, np.float32)
    half[: 3 * H] = 0.5
    return {"x": np.concatenate([(p["e"] @ p["w"][d] + p["b"][d]) * half for d in (0, 1)]), "u": np.ascontiguousarray(p["u"] * half * np.float32(0.5)), "o": p["o"] * np.float32(0.5), "c": p["c"]}


def emissions(q: dict[str, np.ndarray], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores (T, B, TAGS) of windows; ids is (T, B), q is inputs(p)."""
    T, B = ids.shape
    H = q["u"].shape[1]
    at, _ = both_ways(ids, lengths)
    cols = np.arange(B)
    turned = np.stack([ids[at[0], cols], ids[at[1], cols]])
    turned[1] += VOCABULARY
    states = np.zeros((2, T + 1, B, H), np.float32)  # doubled; states[:, t + 1] is the one after t
    c = np.zeros((2, B, H), np.float32)
    z, room, more = (np.empty((2, B, 4 * H), np.float32) for _ in range(3))
    low, lower, new = (np.empty((2, B, H), np.float32) for _ in range(3))
    for t in range(T):
        np.matmul(states[:, t], q["u"], out=z)
        z += np.take(q["x"], turned[:, t], axis=0, out=room, mode="clip")
        tanh(z, room, more)
        np.add(z[..., H : 2 * H], 1, out=new)
        c *= new
        c *= 0.5
        np.add(z[..., :H], 1, out=new)
        new *= z[..., 3 * H :]
        c += new
        np.multiply(c, 0.5, out=new)
        tanh(new, low, lower)
        np.add(z[..., 2 * H : 3 * H], 1, out=low)
        np.multiply(low, new, out=states[:, t + 1])
    out = states[0, 1:] @ q["o"][:H]
    out += (states[1, 1:] @ q["o"][H:])[at[1], cols]
    return out + q["c"]


def loss(p: dict[str, np.ndarray], ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The negative log likelihood per character of the tags (T, B), and its gradient."""
    T, B = ids.shape
    H = p["u"].shape[1]
    at, mask = both_ways(ids, lengths)
    cols = np.arange(B)
    turned = np.stack([ids[at[0], cols], ids[at[1], cols]])
    x = p["e"][turned]
    zx = np.matmul(x.reshape(2, T * B, -1), p["w"]).reshape(2, T, B, 4 * H) + p["b"][:, None, None]
    gates, cells, squashed, states = (np.empty((2, T, B, n), np.float32) for n in (4 * H, H, H, H))
    h, c = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
    for t in range(T):
        z = np.matmul(h, p["u"])
        z += zx[:, t]
        gates[:, t], c, squashed[:, t], h = step(z, c, H)
        cells[:, t], states[:, t] = c, h
    joint = np.concatenate([states[0], states[1][at[1], cols]], axis=2)
    em = joint @ p["o"] + p["c"]
    value, dem, g = crf(p, em, mask, lengths, tags)
    g["o"] = joint.reshape(T * B, -1).T @ dem.reshape(T * B, -1)
    g["c"] = dem.sum((0, 1))
    dj = dem @ p["o"].T
    ds = np.empty((2, T, B, H), np.float32)
    ds[0] = dj[..., :H]
    ds[1] = dj[..., H:][at[1], cols]
    dz = np.empty((2, T, B, 4 * H), np.float32)
    dh, dc = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
    ut = np.swapaxes(p["u"], 1, 2)
    for t in range(T - 1, -1, -1):
        i, f, o, n = (gates[:, t, :, k * H : (k + 1) * H] for k in range(4))
        dh = dh + ds[:, t]
        dc = dc + dh * o * (1 - squashed[:, t] ** 2)
        before = cells[:, t - 1] if t else np.zeros_like(dc)
        d = dz[:, t]
        d[..., :H], d[..., H : 2 * H], d[..., 2 * H : 3 * H], d[..., 3 * H :] = dc * n * i * (1 - i), dc * before * f * (1 - f), dh * squashed[:, t] * o * (1 - o), dc * i * (1 - n * n)
        dc = dc * f
        dh = np.matmul(d, ut)
    dz *= mask[np.arange(T)[None, :, None], cols][..., None]
    flat = dz.reshape(2, T * B, 4 * H)
    g["w"] = np.matmul(np.swapaxes(x.reshape(2, T * B, -1), 1, 2), flat)
    g["b"] = flat.sum(1)
    earlier = np.concatenate([np.zeros((2, 1, B, H), np.float32), states[:, :-1]], axis=1).reshape(2, T * B, H)
    g["u"] = np.matmul(np.swapaxes(earlier, 1, 2), flat)
    dx = np.matmul(flat, np.swapaxes(p["w"], 1, 2))
    g["e"] = np.zeros_like(p["e"])
    np.add.at(g["e"], turned.reshape(-1), dx.reshape(-1, dx.shape[-1]))
    return value, g


def crf(p: dict[str, np.ndarray], em: np.ndarray, mask: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
    """The loss, its gradient by the scores, and by transitions (t), starts (s) and ends (f). Sums of paths are kept at one by scaling."""
    T, B, K = em.shape
    cols, total = np.arange(B), float(lengths.sum())
    top = em.max(2, keepdims=True)
    u = np.exp(em - top)
    move, away = np.exp(p["t"]), np.exp(p["f"])
    a, scale = np.empty((T, B, K), em.dtype), np.ones((T, B, 1), em.dtype)
    now = np.exp(p["s"]) * u[0]
    for t in range(T):
        if t:
            now = np.where(mask[t][:, None], (a[t - 1] @ move) * u[t], a[t - 1])
        scale[t] = now.sum(1, keepdims=True)
        a[t] = now / scale[t]
    ends = (a[-1] * away).sum(1)
    z = ((np.log(scale) + top)[..., 0] * mask).sum(0) + np.log(ends)
    b = np.empty((T, B, K), em.dtype)
    b[-1] = away / ends[:, None]
    g = {"t": np.zeros_like(p["t"])}
    for t in range(T - 2, -1, -1):
        live = mask[t + 1][:, None]
        ahead = u[t + 1] * b[t + 1] / scale[t + 1] * live
        b[t] = np.where(live, ahead @ move.T, b[t + 1])
        g["t"] += a[t].T @ ahead
    g["t"] *= move
    d = a * b * mask[..., None]
    last = lengths - 1
    g["s"] = d[0].sum(0)
    g["f"] = d[last, cols].sum(0)
    score = p["s"][tags[0]] + p["f"][tags[last, cols]] + (np.take_along_axis(em, tags[..., None], 2)[..., 0] * mask).sum(0)
    score = score + (p["t"][tags[:-1], tags[1:]] * mask[1:]).sum(0)
    np.add.at(g["s"], tags[0], -1)
    np.add.at(g["f"], tags[last, cols], -1)
    np.add.at(g["t"], (tags[:-1][mask[1:]], tags[1:][mask[1:]]), -1)
    tt, bb = np.nonzero(mask)
    d[tt, bb, tags[tt, bb]] -= 1
    return float((z - score).sum()) / total, d / total, {k: v / total for k, v in g.items()}


def gains(p: dict[str, np.ndarray], em: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each character of texts that begin at begins, the most that it could add within a span to the path of O alone, and what comes to it if the span begins there."""
    t, o = p["t"], em[:, 0] + p["t"][0, 0]
    within = (em[:, 1:] + t[1:, 1:].max(0)).max(1) - o
    first = (em[:, 1:] + t[0, 1:]).max(1) - o
    first[begins] = (em[begins, 1:] + p["s"][1:]).max(1) - em[begins, 0] - p["s"][0]
    return within.astype(np.float64), (first - within).astype(np.float64)


def leaving(p: dict[str, np.ndarray]) -> float:
    """The most that the end of a span could add."""
    return float(max((p["t"][1:, 0] - p["t"][0, 0]).max(), (p["f"][1:] - p["f"][0]).max()))


def most(within: np.ndarray, enters: np.ndarray) -> np.ndarray:
    """Of each place, the largest value of any span that covers it: the sum of what is within, and what comes for its first place."""
    s = np.concatenate([[0], np.cumsum(within)])
    until = s[1:] + np.maximum.accumulate(enters - s[:-1])
    return until + np.maximum.accumulate(s[:0:-1])[::-1] - s[1:]


def best_path(p: dict[str, np.ndarray], em: np.ndarray) -> np.ndarray:
    """The tags of one whole text, of which em (T, TAGS) are the scores, by Viterbi.

    A span adds at most what its characters could gain, entering and leaving it. A character that no span of a positive bound
    covers is O in the best path, so only the stretches between such characters are walked; the result is the same.
    """
    tags = np.zeros(len(em), np.int8)
    open_ = np.flatnonzero(most(*gains(p, em, np.zeros(1, int))) + leaving(p) > 0)
    for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
        a, b = int(part[0]), int(part[-1]) + 1
        v = em[a] + (p["s"] if a == 0 else p["t"][0])
        back = np.zeros((b - a, TAGS), np.int8)
        for t in range(a + 1, b):
            x = v[:, None] + p["t"]
            back[t - a] = x.argmax(0)
            v = x.max(0) + em[t]
        k = int((v + (p["f"] if b == len(em) else p["t"][:, 0])).argmax())
        for t in range(b - 1, a - 1, -1):
            tags[t] = k
            k = int(back[t - a, k])
    return tags


def windows(n: int, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Begin and end of the overlapping windows of a text of n characters."""
    if n <= window:
        return [(0, n)]
    count = -(-(n - overlap) // (window - overlap))
    return [(a := (n - window) * k // (count - 1), a + window) for k in range(count)]


def scores(texts: list[str], q: dict[str, np.ndarray], batch: int = 256) -> list[np.ndarray]:
    """The scores of whole texts: the mean over the windows that hold a character, with weights that fall to a window's edges."""
    coded = [classes(t) for t in texts]
    out = [np.zeros((len(c), TAGS), np.float32) for c in coded]
    weight = [np.zeros((len(c), 1), np.float32) if len(c) > WINDOW else None for c in coded]
    todo = sorted(((b - a, i, a) for i, c in enumerate(coded) for a, b in windows(len(c)) if b > a), reverse=True)
    for k in range(0, len(todo), batch):
        part = todo[k : k + batch]
        lengths = np.array([n for n, *_ in part])
        ids = np.zeros((lengths[0], len(part)), np.int32)
        for j, (n, i, a) in enumerate(part):
            ids[:n, j] = coded[i][a : a + n]
        em = emissions(q, ids, lengths)
        for j, (n, i, a) in enumerate(part):
            if weight[i] is None:
                out[i] = em[:n, j]
            else:
                w = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), OVERLAP // 2)[:, None].astype(np.float32)
                out[i][a : a + n] += em[:n, j] * w
                weight[i][a : a + n] += w
    return [o if w is None else o / w for o, w in zip(out, weight)]


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Begin, end and kind of the spans of tags."""
    out: list[tuple[int, int, str]] = []
    at = np.flatnonzero(tags)
    begin = None
    for i in at.tolist():
        k, first = (int(tags[i]) - 1) >> 1, tags[i] % 2 == 1
        if begin is not None and (first or i != begin[2] or k != begin[1]):
            out.append((begin[0], begin[2], KINDS[begin[1]]))
            begin = None
        begin = (i, k, i + 1) if begin is None else (begin[0], k, i + 1)
    if begin is not None:
        out.append((begin[0], begin[2], KINDS[begin[1]]))
    return out


def tags_of(spans: list[tuple[int, int, str]], n: int) -> np.ndarray:
    """The tags of spans in a text of n characters."""
    out = np.zeros(n, np.int64)
    for a, b, kind in spans:
        k = 2 * KINDS.index(kind)
        out[a], out[a + 1 : b] = k + 1, k + 2
    return out


def find(p: dict[str, np.ndarray], texts: list[str], q: dict[str, np.ndarray] | None = None) -> list[list[tuple[int, int, str]]]:
    """The spans of private data in each text. Texts in which no stretch can gain over O are found together, and not walked."""
    em = scores(texts, inputs(p) if q is None else q)
    there = [i for i, e in enumerate(em) if len(e)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in em]
    if there:
        sizes = np.array([len(em[i]) for i in there])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        g, e = gains(p, np.concatenate([em[i] for i in there]), begins)
        # Between two texts goes a loss that no span can make up, and at which none begins.
        loss_ = 1 + np.add.reduceat(np.maximum(g, 0) + np.maximum(e, 0), begins)
        g, e = np.insert(g, begins, -loss_ - np.concatenate([[0], loss_[:-1]])), np.insert(e, begins, 0)
        open_ = np.maximum.reduceat(most(g, e), begins + np.arange(len(begins)) + 1)
        for i in np.flatnonzero(open_ + leaving(p) > 0):
            out[there[i]] = spans_of(best_path(p, em[there[i]]))
    return out

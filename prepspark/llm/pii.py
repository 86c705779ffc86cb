"""Personal data: pattern spans plus a character-level bidirectional LSTM with CRF transitions.

Patterns find the base spans. The network, in numpy, adds spans the patterns miss. It is trained on a bounded sample of windows
of the texts, labelled by the patterns, and on windows of that sample into which labelled spans of other spellings were put:
national telephone numbers, mail addresses and ip addresses written around their signs, cards of other lengths and groupings,
and, unlabelled, numbers that are none of these. A span holds a digit, an ``@`` or a bracketed ``at``, so windows are laid,
overlapping, over everything within ``REACH`` characters of one; other text can hold no span. The spans that the windows of a
text decode are reconciled over the whole text: among overlapping ones the set with the highest total score stays.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm.common import edit_text, load, map_text, query, ref

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and from one window to the next: a span of up to their difference lies in a window as a whole.
WINDOW, STRIDE = 128, 48
REACH = 48
HIDDEN = 16
#: Windows of the texts that the network is trained on, at most, windows with other spellings, and rounds over them.
SAMPLE, SPELLED = 2000, 2000
EPOCHS = 12
#: Log odds an added span needs at least.
MARGIN = 2.0

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[(\[{] ?[Aa][Tt] ?[)\]}]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """Pattern spans of a text in code points, by kind, then start. Matches that fail their check are dropped."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= m.end() - m.start() and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def told(spans: list[Span]) -> str:
    """Spans as kind:start:end, by kind as listed, then start."""
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join([f"{k}:{a}:{b}" for k, a, b in order])


# ---- windows and characters

_SIGNS = "@.-+()_%,:;/='\"#*$&![]{}"
_CLASSES = len(_SIGNS) + 8
PAD = _CLASSES - 1


def _class(c: str) -> int:
    if c in _SIGNS:
        return _SIGNS.index(c)
    n = len(_SIGNS)
    if "0" <= c <= "9":
        return n
    if "a" <= c <= "z":
        return n + 1
    if "A" <= c <= "Z":
        return n + 2
    if c == " ":
        return n + 3
    if c.isspace():
        return n + 4
    return n + 5 if c.isalpha() else n + 6


_ASCII = np.array([_class(chr(c)) for c in range(128)], dtype=np.int8)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _ASCII[np.minimum(codes, 127)]
    for k in np.flatnonzero(codes > 127):
        out[k] = _class(text[k])
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows of a text, ``STRIDE`` apart over every region near a mark."""
    regions: list[list[int]] = []
    for m in _MARK.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    return [s for a, b in regions for s in range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)]


# ---- network: tags are O, then begin and inside of every kind

TAGS = 1 + 2 * len(KINDS)
_FORBIDDEN = -1e4
_FIXED = np.zeros((TAGS, TAGS), dtype=np.float32)
for _j in range(len(KINDS)):
    _FIXED[:, 2 + 2 * _j] = _FORBIDDEN
    _FIXED[1 + 2 * _j:3 + 2 * _j, 2 + 2 * _j] = 0
# A window may open inside a span.
_START = np.zeros(TAGS, dtype=np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    m = {"emb": make(2, _CLASSES, 4 * HIDDEN), "rec": make(2, HIDDEN, 4 * HIDDEN), "out": make(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32),
         "trans": np.zeros((TAGS, TAGS), np.float32)}
    m["emb"][:, :, HIDDEN:2 * HIDDEN] += 1
    return m


def forward(m: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    """Emissions (windows, WINDOW, TAGS) and, for training, what the way back needs."""
    both = np.stack([x, x[:, ::-1]])
    n, t_max, H = x.shape[0], x.shape[1], HIDDEN
    h, c = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)
    hs, trace = np.empty((t_max, 2, n, H), np.float32), []
    for t in range(t_max):
        g = np.stack([m["emb"][0][both[0][:, t]], m["emb"][1][both[1][:, t]]]) + h @ m["rec"]
        s, u = _sigmoid(g[..., :3 * H]), np.tanh(g[..., 3 * H:])
        i, f, o = s[..., :H], s[..., H:2 * H], s[..., 2 * H:]
        before = (h, c)
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        if keep:
            trace.append((*before, i, f, o, u, tc))
    joined = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=-1).transpose(1, 0, 2)
    return joined @ m["out"] + m["bias"], (both, joined, trace)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def crf_slopes(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss per window and its slopes by emissions and transitions."""
    n, T, K = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0] + _START
    for t in range(1, T):
        a[:, t] = e[:, t] + _lse(a[:, t - 1][:, :, None] + trans, 1)
    for t in range(T - 2, -1, -1):
        b[:, t] = _lse(trans + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _lse(a[:, -1], 1)
    d = np.exp(a + b - z[:, None, None])
    dt = np.zeros_like(trans)
    for t in range(1, T):
        dt += np.exp(a[:, t - 1][:, :, None] + trans + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows = np.arange(n)[:, None]
    gold = np.take_along_axis(e, y[:, :, None], 2).sum(axis=(1, 2)) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
    d[rows, np.arange(T)[None], y] -= 1
    np.subtract.at(dt, (y[:, :-1], y[:, 1:]), 1)
    return float((z - gold).mean()), d / n, dt / n


def backward(m: dict[str, np.ndarray], d: np.ndarray, saved) -> dict[str, np.ndarray]:
    both, joined, trace = saved
    H = HIDDEN
    slopes = {"out": joined.reshape(-1, 2 * H).T @ d.reshape(-1, TAGS), "bias": d.sum(axis=(0, 1)),
              "emb": np.zeros_like(m["emb"]), "rec": np.zeros_like(m["rec"])}
    dj = d @ m["out"].T
    dh, dc = np.zeros_like(trace[0][0]), np.zeros_like(trace[0][0])
    back, ones = m["rec"].transpose(0, 2, 1), np.eye(_CLASSES, dtype=m["emb"].dtype)
    for t in range(len(trace) - 1, -1, -1):
        h0, c0, i, f, o, u, tc = trace[t]
        dh = dh + np.stack([dj[:, t, :H], dj[:, len(trace) - 1 - t, H:]])
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=-1)
        for k in (0, 1):
            slopes["emb"][k] += ones[both[k][:, t]].T @ dg[k]
        slopes["rec"] += h0.transpose(0, 2, 1) @ dg
        dh, dc = dg @ back, dc * f
    return slopes


def train(windows: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Model from (classes, tags) windows, by Adam with a rate that falls to zero."""
    m = new_model()
    x, y = (np.stack([w[k] for w in windows]).astype(np.int64) for k in (0, 1))
    mean, var, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            at = order[a:a + batch]
            e, saved = forward(m, x[at], keep=True)
            _, d, dt = crf_slopes(e, m["trans"] + _FIXED, y[at])
            slopes = backward(m, d.astype(np.float32), saved) | {"trans": dt}
            size = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
            step += 1
            now = rate * max(0.02, 1 - step / (epochs * -(-len(x) // batch)))
            for k, g in slopes.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                var[k] += 0.001 * (g * g - var[k])
                m[k] = (m[k] - now * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return m


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, T, K = e.shape
    best, back = e[:, 0] + _START, np.empty((n, T, K), dtype=np.int8)
    for t in range(1, T):
        all_ = best[:, :, None] + trans
        back[:, t] = all_.argmax(axis=1)
        best = all_.max(axis=1) + e[:, t]
    path = np.empty((n, T), dtype=np.int8)
    path[:, -1] = best.argmax(axis=1)
    for t in range(T - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path


# ---- spans from windows

def _tags(spans: list[Span], start: int) -> np.ndarray:
    """Tags of a window of a text with these spans; earlier kinds lie on top. Spans may reach beyond the window."""
    y = np.zeros(WINDOW, dtype=np.int8)
    for kind, a, b in sorted(spans, key=lambda s: -KINDS.index(s[0])):
        a, b = a - start, b - start
        if b > 0 and a < WINDOW:
            y[max(a, 0):b] = 2 + 2 * KINDS.index(kind)
            if a >= 0:
                y[a] = 1 + 2 * KINDS.index(kind)
    # What is left of a covered span begins nowhere.
    for k in range(1, WINDOW):
        if y[k] and y[k] % 2 == 0 and y[k - 1] not in (y[k], y[k] - 1):
            y[k] = 0
    return y


def _filled(x: np.ndarray, start: int) -> np.ndarray:
    part = x[start:start + WINDOW]
    return part if len(part) == WINDOW else np.concatenate([part, np.full(WINDOW - len(part), PAD, dtype=part.dtype)])


def sound(kind: str, text: str) -> bool:
    """Whether a decoded span can be of its kind at all: by its digits and parts, not by one spelling."""
    digits = digits_of(text)
    if kind == "email":
        host = _AT_SIGN.split(text)
        return len(host) == 2 and bool(host[0].strip()) and _DOT_SIGN.search(host[1]) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and len(digits) < len(text) and not re.search(r"[^0-9 ()+./-]", text) and not _DATE.fullmatch(text)


_AT_SIGN = re.compile(r"@|\s?[(\[{] ?[Aa][Tt] ?[)\]}]\s?")
_DOT_SIGN = re.compile(r"[A-Za-z0-9](\.|\s?[(\[{] ?[Dd][Oo][Tt] ?[)\]}]\s?)[A-Za-z]{2,}")
_DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}")


# ---- other spellings

def _number(rng: np.random.Generator, n: int, first: str = "123456789") -> str:
    return first[rng.integers(len(first))] + "".join(str(d) for d in rng.integers(0, 10, n - 1))


def _word(rng: np.random.Generator, low: int, high: int) -> str:
    return "".join("abcdefghijklmnopqrstuvwxyz"[k] for k in rng.integers(0, 26, rng.integers(low, high + 1)))


def _card(rng: np.random.Generator, n: int) -> str:
    body = _number(rng, n - 1, "3456")
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def spelled(rng: np.random.Generator) -> tuple[str, str]:
    """(kind, text) of a span in a spelling that the patterns do not know."""
    # Telephone numbers have the most spellings: half of the draws.
    kind, pick = (*KINDS, "phone", "phone")[rng.integers(6)], lambda *xs: xs[rng.integers(len(xs))]
    if kind == "email":
        user = _word(rng, 2, 9) + pick("", "", ".", "_", "-", "1", "77") + _word(rng, 1, 8)
        at = pick(" (at) ", "(at)", " [at] ", "[at]", " {at} ", " (AT) ", "{at}", " [AT] ")
        dot = pick(".", ".", at.replace("at", "dot").replace("AT", "DOT"))
        return kind, user + at + dot.join([_word(rng, 2, 10) for _ in range(rng.integers(1, 3))] + [pick("com", "org", "net", "de", "fr", "es", "example", "info")])
    if kind == "ip":
        return kind, pick("[.]", "(.)", " . ", "[dot]", "{.}").join(str(k) for k in rng.integers(0, 256, 4))
    if kind == "card":
        if rng.integers(2):
            d = _card(rng, 15)
            gap = pick(" ", "-", ".")
            return kind, gap.join([d[:4], d[4:10], d[10:]])
        d = _card(rng, 16)
        return kind, pick(".", "/", "  ", " - ", "_", ", ").join(d[k:k + 4] for k in range(0, 16, 4))
    area, a, b, c = _number(rng, rng.integers(2, 5)), _number(rng, 3), _number(rng, rng.integers(4, 6)), _number(rng, 2)
    return kind, pick(
        f"(0{area}) {a}-{b}", f"(0{area}) {a}{b}", f"0{area}/{a}{b}", f"0{area}-{a}-{b}", f"0{area} {a} {b}", f"0{area} / {a} {c} {c}", f"({_number(rng, 3)}) {a}-{_number(rng, 4)}",
        f"{_number(rng, 3)}-{a}-{_number(rng, 4)}", f"{_number(rng, 3)}.{a}.{_number(rng, 4)}", f"00{_number(rng, 2)} {area} {a} {b}", f"0{area}.{a}.{b}", f"(0{area}){a}{b}")


def unrelated(rng: np.random.Generator) -> str:
    """Numbers, dates and bracketed words that are no personal data."""
    pick, n = lambda *xs: xs[rng.integers(len(xs))], lambda k: _number(rng, k)
    day, month, year = rng.integers(1, 29), rng.integers(1, 13), rng.integers(1900, 2040)
    return pick(
        f"{year}-{month:02d}-{day:02d}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{rng.integers(24):02d}:{rng.integers(60):02d}", n(rng.integers(1, 20)), f"v{n(1)}.{n(1)}.{n(2)}",
        f"{n(2)},{n(3)}.{n(2)}", f"{n(rng.integers(4, 9))}/{n(2)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"({year})", f"{n(2)}-{n(2)}", f"{n(3)} - {n(3)}", f"{n(3)} {n(3)} {_word(rng, 2, 6)}", f"{n(3)}.{n(3)},{n(2)}",
        f"({_word(rng, 1, 3)}) {_word(rng, 2, 6)}", f"{_word(rng, 2, 6)} (at) night", f"[{n(1)}] {_word(rng, 3, 8)}", f"{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}", f"#{n(6)}", f"{n(4)}-{n(4)}", f"{n(1)}) {_word(rng, 2, 5)}", f"{n(5)}.{n(5)}.{n(5)}")


def respelled(windows: list[str], count: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes, tags) of ``count`` windows of the sample with a labelled span, or an unrelated number, put between two of their words."""
    rng, out = np.random.default_rng(seed), []
    for k in range(count if windows else 0):
        text = windows[rng.integers(len(windows))]
        kind, put = ("", unrelated(rng)) if k % 3 == 2 else spelled(rng)
        put = put[:WINDOW]
        cut = int(rng.integers(len(text) + 1))
        while cut < len(text) and text[cut] != " ":
            cut += 1
        left = text[:cut].rstrip(" ")
        left = left + ["", " ", " ", " ", ": ", ", "][rng.integers(6)] if left else left
        whole = left + put + [" ", " ", ", ", ". ", " ", ""][rng.integers(6)] + text[cut:].lstrip(" ")
        start = max(0, int(rng.integers(len(left) + len(put) - WINDOW, len(left) + 1))) if len(left) + len(put) > WINDOW or rng.integers(3) else 0
        spans = [sp for sp in base_spans(whole) if not kind or sp[2] <= len(left) or sp[1] >= len(left) + len(put)]
        if kind:
            spans.append((kind, len(left), len(left) + len(put)))
        out.append((_filled(classes(whole), start), _tags(spans, start)))
    return out


def reconcile(spans: list[tuple[Span, float]]) -> list[Span]:
    """Disjoint spans with the highest total score; a span told by several windows counts with all their scores."""
    total: dict[Span, float] = {}
    for s, score in spans:
        total[s] = total.get(s, 0.0) + score
    rows = sorted(total.items(), key=lambda r: (r[0][2], r[0][1], r[0][0]))
    ends = [r[0][2] for r in rows]
    best: list[float] = [0.0]
    took: list[int] = [-1]
    for k, ((_, a, _), score) in enumerate(rows):
        j = int(np.searchsorted(ends[:k], a, side="right")) if k else 0
        best.append(max(best[-1], best[j] + score))
        took.append(j if best[j] + score > best[-2] else -1)
    out, k = [], len(rows)
    while k:
        if took[k] >= 0:
            out.append(rows[k - 1][0])
            k = took[k]
        else:
            k -= 1
    return out[::-1]


def _odds(e: np.ndarray, path: np.ndarray, trans: np.ndarray, a: int, b: int) -> float:
    """Log odds of a decoded span against none at its place."""
    tags = [*path[a - 1:a], *path[a:b], *path[b:b + 1]]
    none = [*path[a - 1:a], *[0] * (b - a), *path[b:b + 1]] if not b < len(path) or path[b] % 2 or not path[b] else tags
    steps = sum(float(trans[i, j]) for i, j in zip(tags[:-1], tags[1:], strict=True)) - sum(float(trans[i, j]) for i, j in zip(none[:-1], none[1:], strict=True))
    return steps + float((e[np.arange(a, b), path[a:b]] - e[a:b, 0]).sum())


def decode(m: dict[str, np.ndarray], texts: list[str], chunk: int = 256) -> list[list[Span]]:
    """Reconciled spans of the network for each text."""
    found: list[list[tuple[Span, float]]] = [[] for _ in texts]
    rows: list[tuple[int, int]] = []
    wins: list[np.ndarray] = []

    def flush() -> None:
        if not rows:
            return
        e, _ = forward(m, np.stack(wins))
        trans = m["trans"] + _FIXED
        path = viterbi(e, trans)
        for (k, start), p, em in zip(rows, path, e, strict=True):
            at = np.flatnonzero(p)
            for a in at[p[at] % 2 == 1]:
                b = a + 1
                while b < WINDOW and p[b] == p[a] + 1:
                    b += 1
                # Cut by the window's edge: the neighbour sees it whole.
                if (a == 0 and start > 0) or (b == WINDOW and start + b < len(texts[k])):
                    continue
                b, kind = min(b, len(texts[k]) - start), KINDS[(p[a] - 1) // 2]
                margin = _odds(em, p, trans, int(a), int(b))
                if b > a and margin >= MARGIN:
                    found[k].append(((kind, start + int(a), start + int(b)), margin))
        rows.clear()
        wins.clear()

    for k, text in enumerate(texts):
        starts = window_starts(text)
        if starts:
            x = classes(text)
            for s in starts:
                rows.append((k, s))
                wins.append(_filled(x, s))
                if len(rows) >= chunk:
                    flush()
    flush()
    return [[s for s in reconcile(f) if sound(s[0], t[s[1]:s[2]])] if f else [] for f, t in zip(found, texts, strict=True)]


def fit(df: DataFrame, text: str = "text", sample: int = SAMPLE, spelled_windows: int = SPELLED) -> dict[str, np.ndarray] | None:
    """Network trained in one task on at most ``sample`` windows, drawn by hash from all texts with a mark, and on
    ``spelled_windows`` with other spellings put into these; None without any window.

    The windows are counted first, equal ones once, so that hardly more than the sample is sorted. Only the network reaches the driver.
    """
    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                spans, starts = base_spans(t), window_starts(t)
                for k in range(0, len(starts), 10_000):
                    some = starts[k:k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t[s:s + WINDOW] for s in some], pa.string()), pa.array([_tags(spans, s).tobytes() for s in some], pa.binary())],
                        names=["window", "tags"])

    def learn(batches):
        got = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if got:
            rows = [(_filled(classes(w), 0), np.frombuffer(t, np.int8)) for w, t in got]
            model = train(rows + respelled([w for w, _ in got], spelled_windows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(model)), pa.array([list(v.shape) for v in model.values()], pa.list_(pa.int32())), pa.array([v.ravel() for v in model.values()], pa.list_(pa.float32()))],
                names=["name", "shape", "value"])

    rows = df.select(ref(text).cast("string").alias("text")).where(F.col("text").rlike(_MARK.pattern))
    windows = rows.mapInArrow(run, "window string, tags binary").withColumn("h", F.xxhash64("window"))
    different = windows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if not different:
        return None
    bound = -2**63 + min(2**64 - 1, int(1.5 * sample / different * 2**64))
    drawn = windows.where(F.col("h") <= F.lit(bound)).groupBy("h", "window").agg(F.min("tags").alias("tags")).orderBy("h", "window").limit(sample)
    model = drawn.select("window", "tags").coalesce(1).mapInArrow(learn, "name string, shape array<int>, value array<float>").collect()
    return {r["name"]: np.array(r["value"], dtype=np.float32).reshape(r["shape"]) for r in model} or None


def detect(df: DataFrame, model: dict[str, np.ndarray] | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row plus n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added.

    The counts and the digest are those of the base spans; ``spans`` holds base and added ones, ``n_added`` counts the latter. An added
    span overlaps no base span. Null and empty texts have none. Offsets are code points, ends exclusive.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict[str, list]:
        m = shared.value
        base = [base_spans(t) for t in texts]
        more = added(m, texts, base)
        out: dict[str, list] = {f"n_{k}": pa.array([sum(1 for s in b if s[0] == k) for b in base], pa.int64()) for k in KINDS}
        out["base_sha256"] = pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b in base])
        out["spans"] = pa.array([told(b + a) for b, a in zip(base, more, strict=True)])
        out["n_added"] = pa.array([len(a) for a in more], pa.int64())
        return out

    return map_text(df, run, ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint", keep, text)


def added(m: dict[str, np.ndarray] | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans of the network that overlap no base span."""
    if m is None:
        return [[] for _ in texts]
    out = []
    for spans, own in zip(decode(m, texts), base, strict=True):
        taken = sorted((a, b) for _, a, b in own)
        free = []
        for s in spans:
            k = int(np.searchsorted([a for a, _ in taken], s[2])) if taken else 0
            if not any(b > s[1] for _, b in taken[max(0, k - len(KINDS)):k]):
                free.append(s)
        out.append(free)
    return out


def redact(df: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text", size: str | None = None) -> DataFrame:
    """Rows of ``df`` with every span of the text replaced by its kind in angle brackets; null stays null.

    ``size`` names an integer column that is set to the new number of code points where it is not null.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        base = [base_spans(t) for t in texts]
        more = added(shared.value, texts, base)
        new = [cover(t, b + a) for t, b, a in zip(texts, base, more, strict=True)]
        for name, values in ((text, new), (size, [len(t) for t in new])):
            if name is not None:
                k = batch.schema.get_field_index(name)
                old = batch.column(k)
                made = pc.if_else(old.is_valid(), pa.array(values).cast(old.type), old)
                batch = batch.set_column(k, batch.schema.field(k), made)
        return batch

    return edit_text(df, run, text)


def cover(text: str, spans: list[Span]) -> str:
    """Text with its spans replaced; overlapping spans become one, under the kind of the first."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return detect(docs, fit(docs), ["doc_id"])

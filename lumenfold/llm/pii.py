"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

The tagger is trained here, in numpy, on a generated table of labelled spans.  A text
is cut into overlapping windows; each character's tag comes from the window in which
it is furthest from an edge, so neighbouring windows agree on one global tag sequence.
All kinds hold a digit or an @, so windows are decoded from those on, as far as the
tagged spans reach; an added span must hold one.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, values

# The kinds and the base patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
WINDOW, STRIDE = 64, 32
TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    digits = "".join(DIGIT.findall(found))
    if kind == "ip":
        return all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str):
    """The email pattern's matches, found from each @ so that a long word is not tried from every start."""
    done, at = 0, text.find("@")
    pattern = PATTERNS["email"]
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := pattern.match(text, start)):
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _emails(text)]
    if DIGIT.search(text):
        for k in (1, 2, 3):
            if k == 3 and "+" not in text:
                continue
            out += [(k, m.start(), m.end()) for m in PATTERNS[KINDS[k]].finditer(text) if valid(KINDS[k], m[0])]
    return out


# ---- labelled spans ---------------------------------------------------------------------

def char_id(c: str) -> int:
    """0 pad; printable ASCII; line ends; other letters; the rest."""
    o = ord(c)
    return o - 31 if 32 <= o < 127 else 96 if c in "\n\r\t" else 97 if c.isalpha() else 98


CHARS = 99


@lru_cache(maxsize=1)
def _ids() -> np.ndarray:
    return np.array([char_id(chr(i)) for i in range(0x3000)] + [98], dtype=np.int64)


def encoded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _ids()[np.minimum(points, 0x3000)]


def labelled_spans(n: int = 5000, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts of up to WINDOW characters with (kind, start, end) spans, which may reach beyond them; a quarter hold none.

    Words, names and hosts are strings of syllables; numbers that are no personal data (dates,
    times, prices, amounts, ranges, versions, digests, identifiers) stand among them as decoys.
    """
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    some = lambda a, b: int(rng.integers(a, b))
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    plain = ["th", "er", "in", "on", "an", "re", "sch", "ou", "ti", "ing", "ha", "lo", "mi", "st", "ka", "e", "o", "ber", "cu", "zy", "pf", "x", "q", "jo", "wu", "del"]

    def word():
        w = "".join(pick(plain) for _ in range(some(1, 4)))
        if some(0, 12) == 0:
            w += pick(["é", "ß", "ñ", "ü", "日本"])
        return w.capitalize() if some(0, 6) == 0 else w

    def name():
        return "".join(pick(plain) for _ in range(some(1, 4)))

    def email():
        local = name() + pick(["", "", "." + name(), "_" + name(), "-" + name(), "+" + name(), digits(some(1, 4)), "." + digits(2), "_" + digits(1)])
        host = name() + pick(["", "", "-" + name(), digits(1)]) + pick(["", "", "." + name()])
        return local + pick(["@", "@", " @ ", " @ ", "@ ", " @"]) + host + pick([".com", ".org", ".net", ".de", ".co.uk", ".example.com", ".edu", ".io"])

    def ip():
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))

    def card():
        sep = pick(["", "", " ", "-", "."])
        return sep.join([pick("3456") + digits(3), digits(4), digits(4), digits(pick([3, 4, 4, 4]))])

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        zero = "0" + digits(some(1, 4))
        return pick([
            f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{zero}-{b}-{c}", f"({zero}) {b}-{c}", f"{zero} {b} {c}",
            f"+{some(1, 99)} ({a}) {b}-{c}", f"+{some(1, 99)} {a} {b} {c}", f"+{some(1, 99)}-{a}-{b}-{c}", f"1-{a}-{b}-{c}",
        ])

    makers = (email, ip, card, phone)
    hexed = lambda k: hashlib.md5(digits(6).encode()).hexdigest()[:k]
    decoys = (
        lambda: digits(some(1, 8)), lambda: digits(some(8, 24)), lambda: hexed(some(6, 33)), lambda: '"' + hexed(some(16, 33)) + '"', lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.20{digits(2)}",
        lambda: pick("$€£") + digits(some(1, 4)) + "." + digits(2), lambda: f"{digits(some(1, 3))},{digits(3)},{digits(3)}", lambda: "v" + digits(1) + "." + digits(some(1, 3)), lambda: f"{digits(1)}.{digits(some(1, 3))}.{digits(some(1, 3))}",
        lambda: "@" + name(), lambda: "@ " + name(), lambda: name() + " @ " + name(), lambda: "(" + digits(some(1, 5)) + ")", lambda: f"{digits(3)}-{digits(3)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"19{digits(2)}-20{digits(2)}",
        lambda: digits(some(1, 4)) + "%", lambda: "#" + digits(some(2, 7)), lambda: f"{name()}-{digits(some(1, 6))}", lambda: f"{name()}{digits(some(1, 5))}", lambda: f"{digits(some(1, 3))} {digits(some(1, 3))}", lambda: f"{digits(3)} {digits(3)} {digits(3)}",
        lambda: f"0.{digits(some(1, 7))}", lambda: f"{digits(1)}e-{digits(2)}", lambda: f"{pick('ABCDEF')}{digits(2)}-{digits(4)}", lambda: "978-" + digits(1) + "-" + digits(4) + "-" + digits(4) + "-" + digits(1), lambda: f"{digits(2)}-{digits(2)}", lambda: name() + ".com", lambda: f"{name()}.{name()}()",
    )
    out = []
    for i in range(n):
        text, spans = " ".join(word() for _ in range(some(0, 5))), []
        for _ in range(some(0, 3) if i % 4 else 0):
            k = pick([0, 0, 1, 2, 2, 3, 3, 3])
            text += pick([" ", " ", "\n", ": ", " (", ", "]) if text else ""
            found = makers[k]()
            spans.append((k, len(text), len(text) + len(found)))
            text += found
            text += pick(["", "", ".", "%%%", "!!", ",", ")", ";", "\n"])
            if some(0, 2):
                text += " " + word()
        for _ in range(some(0, 3) if i % 4 else some(1, 4)):
            text += pick([" ", " ", " ", ", ", "\n"]) + pick([word, pick(decoys), pick(decoys)])()
        text += " " + " ".join(word() for _ in range(some(0, 6)))
        # a window may begin anywhere, inside a word or a span too; what it cuts off has no label
        at = some(0, max(1, len(text) - 20)) if some(0, 2) == 0 else 0
        cut = text[at : at + WINDOW]
        out.append((cut, [(k, s - at, e - at) for k, s, e in spans if s - at < len(cut) and e > at]))
    return out


# ---- the tagger -------------------------------------------------------------------------

def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(p, ids, keep):
    """Hidden states (T, B, 2 H) of both directions, which run side by side; with `keep` also what back-propagation needs.

    The second direction reads the window from its end; its states are turned back.
    """
    wx, wh, b = p
    B, T = ids.shape
    H = wh.shape[1]
    both = np.stack([ids, ids[:, ::-1]])
    gates = np.take_along_axis(wx[:, None], both.transpose(0, 2, 1).reshape(2, 1, T * B, 1), 2).reshape(2, T, B, 4 * H) + b[:, None, None]
    h, c = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
    out = np.empty((2, T, B, H), np.float32)
    held = {k: np.empty((T, 2, B, H), np.float32) for k in ("h", "c", "i", "f", "o", "u", "tc")} if keep else None
    for t in range(T):
        g = gates[:, t] + h @ wh
        s = _sigmoid(g[..., : 3 * H])
        i, f, o, u = s[..., :H], s[..., H : 2 * H], s[..., 2 * H :], np.tanh(g[..., 3 * H :])
        c2 = f * c + i * u
        tc = np.tanh(c2)
        if keep:
            for k, v in zip(held, (h, c, i, f, o, u, tc), strict=True):
                held[k][t] = v
        h, c = o * tc, c2
        out[:, t] = h
    return np.concatenate([out[0], out[1][::-1]], 2), held


def _lstm_grad(p, ids, held, dout):
    wx, wh, _ = p
    H = wh.shape[1]
    B, T = ids.shape
    down = np.stack([dout[..., :H], dout[::-1, :, H:]])
    back = wh.transpose(0, 2, 1)
    dh, dc = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
    dgs = np.empty((2, T, B, 4 * H), np.float32)
    for t in range(T - 1, -1, -1):
        c, i, f, o, u, tc = (held[k][t] for k in ("c", "i", "f", "o", "u", "tc"))
        dh = dh + down[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 2)
        dgs[:, t] = dg
        dh, dc = dg @ back, dc * f
    flat = dgs.reshape(2, T * B, 4 * H)
    gwh = held["h"].transpose(1, 0, 2, 3).reshape(2, T * B, H).transpose(0, 2, 1) @ flat
    gwx = np.zeros_like(wx)
    for k, read in enumerate((ids, ids[:, ::-1])):
        chars = read.T.reshape(-1)
        order = np.argsort(chars, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(chars[order]) > 0])
        gwx[k, chars[order][first]] = np.add.reduceat(flat[k][order], first, axis=0)
    return [gwx, gwh, flat.sum(1)]


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf_grad(emit, trans, gold):
    """Mean negative log-likelihood of the gold tags, and its gradients."""
    T, B, K = emit.shape
    emit = emit.astype(np.float64)
    a, z = np.empty_like(emit), np.zeros_like(emit)
    a[0] = emit[0]
    for t in range(1, T):
        a[t] = emit[t] + _lse(a[t - 1][:, :, None] + trans[None], 1)
    for t in range(T - 2, -1, -1):
        z[t] = _lse(trans[None] + (emit[t + 1] + z[t + 1])[:, None, :], 2)
    total = _lse(a[-1], 1)
    de = np.exp(a + z - total[None, :, None])
    joint = np.exp(a[:-1, :, :, None] + trans + (emit[1:] + z[1:])[:, :, None, :] - total[None, :, None, None])
    dt = joint.sum((0, 1))
    tags = gold.T
    np.add.at(dt, (tags[:-1], tags[1:]), -1.0)
    score = np.take_along_axis(emit, tags[..., None], 2).sum((0, 2)) + trans[tags[:-1], tags[1:]].sum(0)
    np.put_along_axis(de, tags[..., None], np.take_along_axis(de, tags[..., None], 2) - 1.0, 2)
    return float((total - score).mean()), de / B, dt / B


@lru_cache(maxsize=2)
def trained_tagger(hidden: int = 20, steps: int = 800, batch: int = 48, seed: int = 3) -> tuple:
    """Parameters as arrays, by Adam on the labelled spans; the same on every call."""
    rng = np.random.default_rng(seed)
    table = labelled_spans()
    ids, gold = np.zeros((len(table), WINDOW), np.int64), np.zeros((len(table), WINDOW), np.int64)
    for r, (text, spans) in enumerate(table):
        ids[r, : len(text)] = encoded(text)
        for k, s, e in spans:
            gold[r, max(s, 0) : min(e, len(text))] = 2 + 2 * k
            if s >= 0:
                gold[r, s] = 1 + 2 * k
    new = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    bias = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)
    p = [new(2, CHARS, 4 * hidden), new(2, hidden, 4 * hidden), np.stack([bias, bias]), new(2 * hidden, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(table), batch)
        x, y = ids[rows], gold[rows]
        both, kept = _lstm(p[:3], x, True)
        _, de, dt = _crf_grad(both @ p[3] + p[4], p[5], y)
        grads = _lstm_grad(p[:3], x, kept, (de @ p[3].T).astype(np.float32))
        grads += [np.einsum("tbh,tbk->hk", both, de), de.sum((0, 1)), dt]
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for q, g, a, s in zip(p, grads, m, v, strict=True):
            g = g * min(1.0, 5.0 / (norm + 1e-12))
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tuple(p)


def tags_of(p: tuple, ids: np.ndarray) -> np.ndarray:
    """Viterbi tags (B, T) of windows."""
    emit = _lstm(p[:3], ids, False)[0] @ p[3] + p[4]
    T, B, _ = emit.shape
    best, back = emit[0], np.empty((T, B, TAGS), np.int8)
    for t in range(1, T):
        every = best[:, :, None] + p[5][None]
        back[t] = every.argmax(1)
        best = every.max(1) + emit[t]
    out = np.empty((B, T), np.int64)
    out[:, -1] = best.argmax(1)
    at = np.arange(B)
    for t in range(T - 1, 0, -1):
        out[:, t - 1] = back[t][at, out[:, t]]
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @; windows begin at multiples of the stride."""
    found, last = [], max(0, -(-(len(text) - WINDOW) // STRIDE))
    for m in TRIGGER.finditer(text):
        w = min(m.start() // STRIDE, last)
        for k in (w - 1, w) if w else (0,):
            if not found or k > found[-1]:
                found.append(k)
    return [k * STRIDE for k in found]


def reconciled(length: int, starts: list[int], tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Each character's tag from the window where it is furthest from an edge, read as spans."""
    quarter = (WINDOW - STRIDE) // 2
    last = max(0, -(-(length - WINDOW) // STRIDE)) * STRIDE
    spans, kind, start, end = [], -1, 0, 0
    for s, row in zip(starts, tags, strict=True):
        low = 0 if s == 0 else quarter
        high = min(length - s, WINDOW) if s == last else WINDOW - quarter
        row = row.tolist()
        for j in range(low, high):
            tag = row[j]
            at = s + j
            if tag and tag % 2 == 0 and kind == (tag - 1) // 2 and at == end:
                end = at + 1
            elif tag:
                if kind >= 0:
                    spans.append((kind, start, end))
                kind, start, end = (tag - 1) // 2, at, at + 1
    if kind >= 0:
        spans.append((kind, start, end))
    return spans


def decoded(model: tuple, texts: list[str], batch_windows: int) -> dict[int, tuple[list[int], list]]:
    """Per text with a digit or an @: starts and tags of its windows.

    Where a tagged span touches the edge of what is decoded, the next window is too, until the
    span ends: spans that hold a digit or an @ are those that all windows would give.
    """
    quarter = (WINDOW - STRIDE) // 2
    held: dict[int, dict] = {}
    wanted = [(r, s) for r, t in enumerate(texts) for s in window_starts(t)]
    while wanted:
        more = set()
        for i in range(0, len(wanted), batch_windows):
            part = wanted[i : i + batch_windows]
            ids = np.zeros((len(part), WINDOW), np.int64)
            for j, (r, s) in enumerate(part):
                piece = encoded(texts[r][s : s + WINDOW])
                ids[j, : len(piece)] = piece
            for (r, s), row in zip(part, tags_of(model, ids), strict=True):
                held.setdefault(r, {})[s] = row
                if s and row[quarter]:
                    more.add((r, s - STRIDE))
                if s + WINDOW < len(texts[r]) and row[WINDOW - quarter - 1]:
                    more.add((r, s + STRIDE))
        wanted = sorted((r, s) for r, s in more if s not in held[r])
    return {r: (sorted(x), [x[s] for s in sorted(x)]) for r, x in held.items()}


PLAUSIBLE = {
    "email": re.compile(r"[\w.%+-]+\s?@\s?[\w-]+(\.[\w-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ .\-]?[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9][ ().0-9-]+[0-9]"),
}


def added_spans(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tagger's spans that are well-formed and overlap no base span."""
    out = []
    for k, s, e in found:
        raw = text[s:e]
        s, e = s + len(raw) - len(raw.lstrip(" ,;:\n")), e - (len(raw) - len(raw.rstrip(" ,;:.!\n")))
        if s >= e or any(x < e and s < y for _, x, y in base):
            continue
        if any(0 <= i < len(text) and text[i].isalnum() for i in (s - 1, e)):
            continue  # a part of a longer token
        if PLAUSIBLE[KINDS[k]].fullmatch(text, s, e) and valid(KINDS[k], text[s:e]):
            if k == 3 and not (text[s] in "+(" or re.search(r"[ ().-]", text[s:e])):
                continue  # a plain number is no phone number
            out.append((k, s, e))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_windows: int = 2048
) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of the base spans; `spans` has those and the added
    ones as kind:start:end (code points, end exclusive) by kind and start.  Null and
    empty texts have none; null ids stay, repeated rows are scanned each, extra columns
    are ignored, an empty table gives no rows.  Texts of any length are scanned whole,
    `batch_windows` windows at a time.  Equal spans of two
    windows are one; no two spans of a text overlap but for base spans of two kinds.
    """
    model = trained_tagger()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def found(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        tags = decoded(model, texts, batch_windows)
        columns: list[list] = [[] for _ in range(7)]
        for r, t in enumerate(texts):
            base = base_spans(t)
            more = added_spans(t, base, reconciled(len(t), *tags[r])) if r in tags else []
            for k in range(4):
                columns[k].append(sum(x[0] == k for x in base))
            columns[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            columns[5].append(_joined([*base, *more]))
            columns[6].append(len(more))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    def run(batches):
        for b in batches:
            first, texts, size = 0, [], 0
            for t in values(b.column(1)):
                texts.append(t)
                size += len(t)
                if len(texts) == 2048 or size > 4_000_000:
                    yield found(b.column(0).slice(first, len(texts)), texts)
                    first, texts, size = first + len(texts), [], 0
            if texts:
                yield found(b.column(0).slice(first, len(texts)), texts)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    out = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(releasing(run), schema)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)

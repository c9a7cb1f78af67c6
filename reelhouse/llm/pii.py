"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The patterns (email, ip, card, phone) give the base spans. The network finds what is written otherwise:
addresses with "at" and "dot" spelled out, telephone numbers without a country code, numbers of
national registers and accounts. It is trained here, in numpy, from labelled spans: the base spans of
a bounded sample of documents, and the same places with such other forms put in.

A text is decoded in windows of ``WIDTH`` characters, one every ``STRIDE``. A span of the network's kinds has a
digit, an at sign or the word "at" (``_worth``), so only windows whose middle holds one of them are
decoded: "at" in any case, bare or between brackets of any kind; every possible span lies whole in one of them unless it is longer
than half a window. What the windows propose is reconciled over the whole text: of all sets of spans
that don't overlap, and don't overlap base spans, the one with the largest sum of scores is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
#: Kinds that the network adds.
ADDED = ("address", "number")
KINDS = BASE + ADDED
WIDTH, STRIDE = 96, 48
#: Documents of which the labelled spans are taken, and windows that the network is fitted to.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2_000, 2_000
#: Characters of the longest text that the sample takes, which bounds what the driver holds of it.
SAMPLE_CHARS = 20_000

_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
#: The word "at": no ASCII letter, digit or underline around it.
_AT = r"(?<![A-Za-z0-9_])[Aa][Tt](?![A-Za-z0-9_])"
_TRIGGER = re.compile(rf"[0-9@]|{_AT}")
#: Where a training window might hold a span that nothing labels; a bare "at" of prose is to be learned as none.
_UNSURE = re.compile(rf"[0-9@]|[\[({{<] ?{_AT} ?[\])}}>]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@`` and a domain: a match begins where its run of local characters does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in order, kinds by their number in ``BASE``.

    Each kind's matches are the leftmost ones that don't overlap; those that fail the kind's check are dropped.
    """
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Longer parts than four thousand digits aren't read as numbers.
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the network

#: Characters that have a symbol of their own; all others share one for each rough class.
_OWN = "0123456789@.,:;-_+()[]/ \n'\"#=&"
_SYMBOL = {c: i for i, c in enumerate(_OWN)}
_SYMBOL |= {chr(c): len(_OWN) + c - 97 for c in range(97, 123)}
_UPPER, _LETTER, _OTHER = range(len(_SYMBOL), len(_SYMBOL) + 3)
SYMBOLS = _OTHER + 1
_TABLE = np.full(128, _OTHER, np.int16)
for _c, _i in _SYMBOL.items():
    _TABLE[ord(_c)] = _i
_TABLE[65:91] = _UPPER


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], _LETTER).astype(np.int16)


#: Labels: 0 outside, then for each kind its first character and the others.
LABELS = 1 + 2 * len(KINDS)


@dataclass
class Tagger:
    """Weights: embedding, for each direction input, recurrent and bias, output and its bias, transitions, first label."""

    weights: list[np.ndarray]

    @classmethod
    def new(cls, embedded: int = 10, hidden: int = 16, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)

        def of(*shape: int) -> np.ndarray:
            return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

        weights = [rng.normal(0, 0.3, (SYMBOLS, embedded)).astype(np.float32)]
        for _ in range(2):
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # to remember at first
            weights += [of(embedded, 4 * hidden), of(hidden, 4 * hidden), bias]
        weights += [of(2 * hidden, LABELS), *(np.zeros(shape, np.float32) for shape in (LABELS, (LABELS, LABELS), LABELS))]
        return cls(weights)

    def _direction(self, x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, trace: bool):
        """Hidden states of (time, batch, embedded) ``x`` in its order; ``trace``: also what the way back needs."""
        steps, batch, _ = x.shape
        size = len(u)
        given = x @ w + b
        h, c = np.zeros((batch, size), x.dtype), np.zeros((batch, size), x.dtype)
        out = np.empty((steps, batch, size), x.dtype)
        kept = []
        for t in range(steps):
            z = given[t] + h @ u
            gates = 1 / (1 + np.exp(-z[:, : 3 * size]))
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            before = c
            c = f * c + i * g
            squashed = np.tanh(c)
            if trace:
                kept.append((h, before, i, f, o, g, squashed))
            h = out[t] = o * squashed
        return out, kept

    def emissions(self, chars: np.ndarray, trace: bool = False):
        """(time, batch, labels) scores of (batch, time) symbols."""
        e, *rest = self.weights
        x = e[chars.T]
        forward, kept_f = self._direction(x, *rest[:3], trace)
        backward, kept_b = self._direction(x[::-1], *rest[3:6], trace)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        return both @ rest[6] + rest[7], (x, both, kept_f, kept_b)

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best labels (batch, time), and by how much each character's label beats outside in the emissions."""
        scores, _ = self.emissions(chars)
        moves, first = self.weights[9], self.weights[10]
        best = scores[0] + first
        back = []
        for row in scores[1:]:
            ways = best[:, :, None] + moves
            back.append(ways.argmax(axis=1))
            best = ways.max(axis=1) + row
        at = best.argmax(axis=1)
        labels = [at]
        for ways in reversed(back):
            at = np.take_along_axis(ways, at[:, None], 1)[:, 0]
            labels.append(at)
        labels = np.array(labels[::-1]).T
        chosen = np.take_along_axis(scores.transpose(1, 0, 2), labels[:, :, None], 2)[:, :, 0]
        return labels, chosen - scores[:, :, 0].T

    def _back(self, out: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list):
        """Gradients of x, w, u and b from that of the hidden states."""
        size = len(u)
        dz = np.empty((len(x), x.shape[1], 4 * size), x.dtype)
        dh = dc = 0
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, o, g, squashed = kept[t]
            dh = out[t] + dh
            dc = dc + dh * o * (1 - squashed**2)
            dz[t, :, :size] = dc * g * i * (1 - i)
            dz[t, :, size : 2 * size] = dc * before * f * (1 - f)
            dz[t, :, 2 * size : 3 * size] = dh * squashed * o * (1 - o)
            dz[t, :, 3 * size :] = dc * i * (1 - g**2)
            dc = dc * f
            dh = dz[t] @ u.T
        hidden = np.stack([k[0] for k in kept])
        return dz @ w.T, np.tensordot(x, dz, ((0, 1), (0, 1))), np.tensordot(hidden, dz, ((0, 1), (0, 1))), dz.sum(axis=(0, 1))

    def gradients(self, chars: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The CRF's mean negative log likelihood of (batch, time) labels, and its gradients."""
        scores, (x, both, kept_f, kept_b) = self.emissions(chars, trace=True)
        e, wf, uf, _, wb, ub, _, v, _, moves, first = self.weights
        steps, batch, k = scores.shape
        alpha = np.empty_like(scores)
        alpha[0] = scores[0] + first
        for t in range(1, steps):
            ways = alpha[t - 1][:, :, None] + moves
            top = ways.max(axis=1)
            alpha[t] = np.log(np.exp(ways - top[:, None]).sum(axis=1)) + top + scores[t]
        top = alpha[-1].max(axis=1)
        total = np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1)) + top
        beta = np.zeros((batch, k), scores.dtype)
        p = np.empty_like(scores)
        d_moves = np.zeros_like(moves)
        for t in range(steps - 1, -1, -1):
            p[t] = np.exp(alpha[t] + beta - total[:, None])
            if t:
                ahead = beta + scores[t]
                d_moves += np.exp(alpha[t - 1][:, :, None] + moves + ahead[:, None, :] - total[:, None, None]).sum(axis=0)
                ways = moves + ahead[:, None, :]
                top = ways.max(axis=2)
                beta = np.log(np.exp(ways - top[:, :, None]).sum(axis=2)) + top
        y = labels.T
        rows = np.arange(batch)
        gold = first[y[0]] + scores[0][rows, y[0]]
        d_first = p[0].sum(axis=0)
        np.add.at(d_first, y[0], -1)
        for t in range(steps):
            p[t][rows, y[t]] -= 1
            if t:
                gold = gold + moves[y[t - 1], y[t]] + scores[t][rows, y[t]]
                np.add.at(d_moves, (y[t - 1], y[t]), -1)
        dv = np.tensordot(both, p, ((0, 1), (0, 1)))
        d_both = p @ v.T
        half = both.shape[2] // 2
        dx, dwf, duf, dbf = self._back(d_both[:, :, :half], x, wf, uf, kept_f)
        dxb, dwb, dub, dbb = self._back(d_both[::-1, :, half:], x[::-1], wb, ub, kept_b)
        de = np.zeros_like(e)
        np.add.at(de, chars.T, dx + dxb[::-1])
        grads = [de, dwf, duf, dbf, dwb, dub, dbb, dv, p.sum(axis=(0, 1)), d_moves, d_first]
        return float((total - gold).mean()), [g / batch for g in grads]


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 5, batch: int = 64, seed: int = 0) -> Tagger:
    """Fit a tagger to texts of up to ``WIDTH`` characters with labelled spans (start, kind, end) by Adam."""
    tagger = Tagger.new(seed=seed)
    if not windows:
        return tagger
    chars = np.full((len(windows), WIDTH), _SYMBOL[" "], np.int16)
    labels = np.zeros((len(windows), WIDTH), np.int64)
    for i, (text, spans) in enumerate(windows):
        s = symbols(text[:WIDTH])
        chars[i, : len(s)] = s
        for a, kind, b in spans:
            labels[i, a:b] = 2 * kind + 2
            labels[i, a : a + 1] = 2 * kind + 1
    rng = np.random.default_rng(seed)
    slow, fast = ([np.zeros_like(w) for w in tagger.weights] for _ in range(2))
    steps, t = epochs * -(-len(windows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            _, grads = tagger.gradients(chars[rows], labels[rows])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            t += 1
            rate = 0.03 * (1 - (t - 1) / steps)
            for w, g, m, v in zip(tagger.weights, grads, slow, fast):
                g = g * min(1, 5 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return tagger


# --- labelled spans


def _name(rng) -> str:
    """A made-up name of two to four syllables."""
    pick = lambda of: of[rng.integers(len(of))]
    parts = (pick("b c d f g h j k l m n p r s t v w z ch st br".split()) + pick("aeiou") + pick(["", "", "n", "r", "s", "l", "m"]) for _ in range(rng.integers(2, 5)))
    return "".join(parts)


def _other_form(kind: int, found: str, rng) -> tuple[str, int] | None:
    """``found`` written as the patterns don't know it, and its kind among the added ones."""
    digits = "".join(c for c in found if c.isdigit())

    def draw(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    if kind == 0:
        user, _, host = found.partition("@")
        forms = [(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" {at} ", "."), (" at ", "."), ("<at>", "<dot>")]
        left, right = forms[rng.integers(len(forms))]
        if rng.integers(3):  # names without digits, such as people's
            user = ["", ".", "_"][rng.integers(3)].join(_name(rng) for _ in range(1 + rng.integers(2)))
            host = _name(rng) + "." + host.rpartition(".")[2] if rng.integers(2) else host
        other = user + left + host.replace(".", right)
        return other.upper() if not rng.integers(4) else other, len(BASE)
    if kind == 3:
        d = digits[-10:].rjust(10, "5")
        forms = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"0{d[:3]} {d[3:]}"]
        return forms[rng.integers(4)], len(BASE) + 1
    d = draw(9)
    forms = [f"{d[:3]}-{d[3:5]}-{d[5:]}", "DE" + draw(2) + "".join(" " + draw(4) for _ in range(4)) + " " + draw(2)]
    return forms[rng.integers(2)], len(BASE) + 1


def _plain_number(rng) -> str:
    """Numbers that aren't personal."""
    n = rng.integers(0, 10**6)
    return [str(n % 1000), f"{1990 + n % 40}", f"{n / 100:.2f}", f"{n % 24:02}:{n % 60:02}", f"{n % 100} %", f"§ {n % 300}", f"v{n % 9}.{n % 10}"][
        rng.integers(7)
    ]


def labelled_windows(texts: list[str], most: int = SAMPLE_WINDOWS, seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows around the base spans of ``texts``, as they are and with other forms or plain numbers put in."""
    rng = np.random.default_rng(seed)
    out: list[tuple[str, list[tuple[int, int, int]]]] = []
    for text in texts:
        spans = base_spans(text)
        for at, kind, end in spans:
            if end - at > WIDTH // 2:
                continue
            room = WIDTH - (end - at)
            lead = int(rng.integers(0, min(room, at) + 1))
            a = at - lead
            inside = [(s - a, k, e - a) for s, k, e in spans if s >= a and e <= a + WIDTH]
            clear: list[tuple[int, int, int]] = []
            for s in sorted(inside, key=lambda s: (s[0], -s[2])):
                if not clear or s[0] >= clear[-1][2]:
                    clear.append(s)
            out.append((text[a : a + WIDTH], clear))
            other, added = _other_form(kind, text[at:end], rng)
            if len(other) <= WIDTH // 2:
                head = text[max(0, at - int(rng.integers(0, WIDTH - len(other) + 1))) : at]
                if not _UNSURE.search(head):
                    tail = text[end : end + WIDTH - len(head) - len(other)]
                    if not _UNSURE.search(tail):
                        out.append((head + other + tail, [(len(head), added, len(head) + len(other))]))
                        plain = _plain_number(rng)
                        out.append((head + plain + tail[: WIDTH - len(head) - len(plain)], []))
        if len(out) >= most:
            break
        if len(text) > WIDTH:
            a = int(rng.integers(0, len(text) - WIDTH))
            if not base_spans(text[a : a + WIDTH]) and not _UNSURE.search(text[a : a + WIDTH]):
                out.append((text[a : a + WIDTH], []))
    return out[:most]


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Tagger:
    """A tagger from the ``sample_docs`` documents with a digit or at sign whose texts have the smallest hashes.

    Texts of over ``SAMPLE_CHARS`` characters aren't in the sample; decoding takes all texts whole.
    Without such a document the tagger is untrained and adds nothing.
    """
    text = F.col(text_col)
    some = docs.select(text.alias("text")).where(text.rlike("@[A-Za-z0-9-]+[.]|[0-9]{4}|[0-9][.][0-9]+[.]"))
    some = some.where(F.length("text") <= SAMPLE_CHARS).select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(sample_docs)
    windows = labelled_windows([r["text"] for r in some.select("text").toLocalIterator()])
    return train(windows) if windows else Tagger([])


# --- decoding


def _windows(text: str) -> list[int]:
    """Where the windows to decode begin, in multiples of ``STRIDE``: those with a trigger in their middle half."""
    found = set()
    for m in _TRIGGER.finditer(text):
        at = (m.start() - STRIDE // 2) // STRIDE
        found.add(max(0, at) * STRIDE)
    return sorted(found)


def _joined(parts: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Parts that windows cut off at their ends, each joined with those of its kind that it overlaps or touches."""
    out: list[tuple[float, int, int, int]] = []
    for score, a, kind, b in sorted(parts, key=lambda p: (p[2], p[1], p[3])):
        if out and out[-1][2] == kind and a <= out[-1][3]:
            out[-1] = (out[-1][0] + score, out[-1][1], kind, max(b, out[-1][3]))
        else:
            out.append((score, a, kind, b))
    return out


def _proposals(texts: list[str], tagger: Tagger) -> list[list[tuple[float, int, int, int]]]:
    """(score, start, kind, end) of added kinds that any window of a text proposes.

    What a window cuts off is joined with what the next one proposes there, so a span may be longer
    than a window.
    """
    places = [(i, a) for i, text in enumerate(texts) for a in _windows(text)]
    out: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    parts: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    for k in range(0, len(places), 512):
        part = places[k : k + 512]
        chars = np.full((len(part), WIDTH), _SYMBOL[" "], np.int16)
        for row, (i, a) in enumerate(part):
            s = symbols(texts[i][a : a + WIDTH])
            chars[row, : len(s)] = s
        labels, margins = tagger.decode(chars)
        for row in np.flatnonzero((labels > 2 * len(BASE)).any(axis=1)):
            i, a = part[row]
            text, line, margin = texts[i], labels[row], margins[row]
            kinds = (line - 1) // 2
            n = min(WIDTH, len(text) - a)
            at = 0
            while at < n:
                if line[at] <= 2 * len(BASE):
                    at += 1
                    continue
                end = at + 1
                while end < n and line[end] == 2 * kinds[at] + 2:
                    end += 1
                cut = (at == 0 and a > 0) or (end == WIDTH and a + WIDTH < len(text))
                # One that the window cuts yields to a whole one.
                score = float(margin[at:end].sum()) * (0.25 if cut else 1)
                (parts if cut else out)[i].append((score, a + at, int(kinds[at]), a + end))
                at = end
    return [own + _joined(cut) for own, cut in zip(out, parts)]


def _reconciled(proposed: list[tuple[float, int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The proposals that don't overlap each other or a base span and have the largest sum of scores."""
    best: dict[tuple[int, int, int], float] = {}
    taken_up = sorted((a, b) for a, _, b in base)
    starts, reach = [a for a, _ in taken_up], list(accumulate((b for _, b in taken_up), max))
    for score, a, kind, b in proposed:
        before = bisect_left(starts, b)  # base spans that begin before this one ends
        if score > 0 and not (before and reach[before - 1] > a):
            best[a, kind, b] = max(score, best.get((a, kind, b), 0.0))
    spans = sorted(best, key=lambda s: s[2])
    ends = [s[2] for s in spans]
    sums, taken = [0.0], []
    for k, s in enumerate(spans):
        j = bisect_right(ends, s[0], 0, k)
        with_it = sums[j] + best[s]
        taken.append((with_it > sums[-1], j))
        sums.append(max(sums[-1], with_it))
    out, k = [], len(spans)
    while k:
        use, j = taken[k - 1]
        if use:
            out.append(spans[k - 1])
        k = j if use else k - 1
    return out[::-1]


#: What a number may look like: groups of digits, in an account number after two letters.
_NUMBER = re.compile(r"(?:[A-Z]{2}(?=[0-9]{2}))?[0-9() ./+-]+")
#: Digits that tell a day or a time, whatever follows.
_STAMP = re.compile(r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([/.])[0-9]{1,2}\2[0-9]{4}(?![0-9])")
#: What says that a number is a book's.
_BOOK = re.compile(r"ISBN(?:-1[03])?:? ?$", re.IGNORECASE)
#: An account number's further groups.
_GROUPS = re.compile(r"(?: ?[0-9]{1,4})*(?![0-9])")


def _worth(text: str, kind: int) -> bool:
    """What a span of an added kind has by definition."""
    if kind == len(BASE):
        return bool(re.search(rf"@|{_AT}", text)) and ("." in text or "dot" in text.lower()) and len(text) >= 8
    return 7 <= sum(c.isdigit() for c in text) <= 34 and bool(_NUMBER.fullmatch(text)) and not _STAMP.match(text)


def _whole(text: str, a: int, kind: int, b: int) -> tuple[int, int, int]:
    """A proposal without punctuation around it, and with the whole of the words and numbers that it begins or ends in."""
    while a < b and text[a] in " \n,;:.":
        a += 1
    while b > a and text[b - 1] in " \n,;:.":
        b -= 1
    while a < b and 0 < a and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while a < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    if kind > len(BASE) and a < b:
        # Digits that dots and hyphens join are one number, as in a version.
        while a > 1 and text[a].isdigit() and text[a - 1] in ".-" and text[a - 2].isdigit():
            a -= 2
            while a > 0 and text[a - 1].isdigit():
                a -= 1
        while b + 1 < len(text) and text[b - 1].isdigit() and text[b] in ".-" and text[b + 1].isdigit():
            b += 2
            while b < len(text) and text[b].isdigit():
                b += 1
    if kind > len(BASE) and text[a : a + 2].isalpha():
        b = _GROUPS.match(text, b).end()
    return a, kind, b


def find(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """For each whole text its base spans and all its spans, as (start, kind, end) in order."""
    base = [base_spans(t) for t in texts]
    proposed = _proposals(texts, tagger) if tagger.weights else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, proposed):
        near = []
        if more:
            more = [(s, a, k, b) for s, a, k, b in ((s, *_whole(text, a, k, b)) for s, a, k, b in more) if _worth(text[a:b], k)]
            more = [m for m in more if not _BOOK.search(text[max(0, m[1] - 10) : m[1]])]
            low, high = min((m[1] for m in more), default=0), max((m[3] for m in more), default=0)
            near = _reconciled(more, [s for s in own if s[0] < high and s[2] > low])
        out.append((own, sorted(own + near)))
    return out


def spans_column(spark: SparkSession, text: Column, tagger: Tagger) -> Column:
    """A struct of ``base`` and ``spans``: arrays of (start, kind, end), code points of the whole text, end exclusive."""
    common.importable_on_workers(spark)
    shared = spark.sparkContext.broadcast(tagger)  # some ten thousand numbers
    span = "array<struct<start: int, kind: int, end: int>>"

    @F.arrow_udf(f"struct<base: {span}, spans: {span}>")
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        found = find([t or "" for t in texts.to_pylist()], shared.value)
        named = [{k: [dict(zip(("start", "kind", "end"), s)) for s in spans] for k, spans in zip(("base", "spans"), f)} for f in found]
        return pa.array(named, pa.struct([("base", kind), ("spans", kind)]))

    return of(text)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(``id_col``, base, spans), one row per input row; see ``spans_column``.

    A null text counts as empty and has no spans. Rows with null or repeated ids are each judged
    alone. An empty table gives an empty result. Other columns aren't read. Nothing is shuffled.
    """
    tagger = fit(docs, text_col) if tagger is None else tagger
    found = docs.select(F.col(id_col), spans_column(docs.sparkSession, F.col(text_col), tagger).alias("f"))
    return found.select(id_col, "f.base", "f.spans")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    part = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", part)


def _count(spans: str, kind: int) -> Column:
    # A function of one argument: a second one would be the element's place.
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.read(spark, sf_dir, "documents"))
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))

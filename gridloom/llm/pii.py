"""Personal data: rule spans plus a character-level BiLSTM-CRF.

The rules give the base spans of e-mail addresses, IPv4 addresses, card numbers and
phone numbers. A bidirectional LSTM over characters with CRF transitions, trained in
numpy from labelled spans, adds spans that the rules miss, such as phone numbers in
national groupings and addresses written with ``[at]`` and ``[dot]``. The model's score
decides; of a span of its own only what its kind is by definition is checked (number of
digits, Luhn, number range, an at and a dot).

Every kind of span holds a digit, an ``@``, an at-mark or a dot-mark, so only
stretches around such triggers, grown to the white space beyond ``MARGIN`` characters,
can hold a span; all of these, in the whole text, are cut into overlapping windows.
Each window is decoded by Viterbi. A span that a window's edge cuts gives way to a
window that sees it whole; where no window did, one is decoded around it, and for an
address twice as long ones up to ``LONGEST`` characters, over which there is none (64 for
the name, 255 for the host, and marks between); other kinds have too few digits to be
cut twice. The windows' spans are then reconciled over the whole text: of all non-overlapping sets that of the
largest total score is kept (weighted interval scheduling). Base spans have no limit.

Training is deterministic: ``training_spans`` writes labelled sentences from a seed
(``TRAIN_SENTENCES``, the documented bound), so no label of the corpus is used.

Defined results: a null or empty text has no spans; positions are code points, end
exclusive; base spans stay, and model spans that touch one are left out, as are
model spans that fail their kind's own check; repeated rows and null ids keep their
rows; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import documents, map_rows, text_or_empty

KINDS = ("email", "ip", "card", "phone")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
AT = re.compile(r"(?i)\x20?[\[(]at[\])]\x20?")
TRIGGER = re.compile(r"(?i)[0-9@]|[\[(](?:at|dot)[\])]")

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STEP, MARGIN = 96, 48, 32
#: The widest window around a span that narrower ones cut.
LONGEST = 384
TRAIN_SENTENCES, EPOCHS, EMBED, HIDDEN = 3000, 12, 8, 16
#: What a span's characters score over the tag O on average, at least.
SURE = 0.3
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Character classes: these one by one, then lower, upper, digit, space, line feed, other, padding.
_SINGLE = "@.-+()[]_%/:,#$=*'\""
N_CLASSES = len(_SINGLE) + 7


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Rule spans, leftmost and non-overlapping within a kind, by kind as listed, then start."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := HOST.match(text, at)):
            found.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGITS.search(text):
        return found
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(small, m.groups()))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return found


def plausible(piece: str, kind: str) -> bool:
    """What a span of this kind is by definition."""
    digits = "".join(DIGITS.findall(piece))
    if kind == "email":
        return bool(re.search(r"(?i)@|\bat\b", piece) and re.search(r"(?i)\.|\bdot\b", piece)) and "\n" not in piece
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and "\n" not in piece


def classes(text: str) -> np.ndarray:
    n = len(_SINGLE)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 256, _table()[np.minimum(codes, 255)], n + 5)


@cache
def _table() -> np.ndarray:
    n = len(_SINGLE)
    out = np.full(256, n + 5)
    for c in range(128):
        ch = chr(c)
        out[c] = _SINGLE.index(ch) if ch in _SINGLE else n if ch.islower() else n + 1 if ch.isupper() else n + 2 if ch.isdigit() else n + 4 if ch == "\n" else n + 3 if ch.isspace() else n + 5
    return out


#: Groupings of phone numbers to learn from; ``#`` stands for a digit.
PHONES = (
    "+1 (###) ###-####", "+## ### ### ####", "(###) ###-####", "(###) ###-####", "###-###-####", "###-###-####", "###.###.####", "### ### ####", "1-###-###-####", "0#### ######", "0#### ######", "0### #######", "0### ### ####", "(0##) #######", "(0####) ######", "0##/#######", "0#### / ######",
    "0# ## ## ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "00## ## #######", "00## # ## ## ## ##", "00## ### #######", "9## ### ###", "6## ## ## ##", "0###-######", "0##-#######",
)


def training_spans(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled sentences: invented words with personal data, and look-alikes without a label."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda a=2, b=9: "".join(_LETTERS[i] for i in rng.integers(0, 26, rng.integers(a, b)))

    fill = lambda form: "".join(digits(1) if c == "#" else c for c in form)

    def card() -> str:
        body = str(rng.integers(3, 7)) + digits(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = pick(["", " ", "-", " "])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at = pick(["@", "@", " [at] ", "(at)", " (at) ", "[at]", " [AT] "])
        dot = pick([".", ".", ".", " [dot] ", "[dot]", " (dot) ", "(dot)"]) if at != "@" else "."
        name = word() + pick(["", ".", "_", "-"]) + pick([word(), digits(2), ""])
        return (name.rstrip("._-") or word()) + at + dot.join([word() for _ in range(rng.integers(1, 3))] + [pick(["com", "org", "net", "de", "fr", "es", "example", "io"])])

    makers = {
        "email": email,
        "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        "card": card,
        "phone": lambda: fill(pick(PHONES)),
    }
    fakes = [
        lambda: f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}", lambda: f"{rng.integers(1900, 2100)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.{rng.integers(1900, 2100)}", lambda: f"{rng.integers(0, 24)}:{digits(2)}", lambda: f"${digits(2)},{digits(3)}.00",
        lambda: digits(rng.integers(1, 13)), lambda: "%0*x" % (24, int(rng.integers(1 << 62))), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"@{word()}", lambda: f"#{digits(4)}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"({digits(4)})", lambda: digits(16),
        lambda: f"{digits(1)}.{digits(5)}", lambda: f"{rng.integers(1, 99)},{digits(3)},{digits(3)}", lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}", lambda: f"{rng.integers(1, 100)} {pick(['of', 'at', 'to'])} {rng.integers(1, 100)}", lambda: f"{word()} at {word()}", lambda: f"the dot {word()}",
        lambda: fill("978-#-##-######-#"), lambda: fill("##/##/####"), lambda: " ".join(digits(rng.integers(1, 3)) for _ in range(rng.integers(2, 6))), lambda: fill("##.##.#.#.#"), lambda: fill("####-##-## ##:##:##"), lambda: fill("0x########"), lambda: f"{word()}{digits(2)}", lambda: f"ID-{digits(8)}", lambda: f"no. {digits(6)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}", lambda: fill("### ### ###"),
    ]
    lead = ["call ", "phone ", "tel. ", "Tel: ", "fax ", "mail ", "e-mail: ", "contact ", "write to ", "from ", "card ", "ip ", "to ", ""]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(3, 9)):
            u = rng.random()
            if u < 0.3:
                kind = pick((*KINDS, "phone", "email"))
                text += pick(lead)
                piece = makers[kind]()
                spans.append((len(text), len(text) + len(piece), kind))
            else:
                piece = pick(fakes)() if u < 0.45 else word() if u < 0.9 else word().capitalize()
            text += piece + pick([" ", " ", " ", ", ", ". ", "\n"])
        out.append((text, spans))
    return out


class BiLstmCrf:
    """Embedding, one LSTM each way, linear tag scores, CRF transitions; all in numpy.

    Both directions run side by side: arrays are (time, direction, batch, ...), the
    second direction's time goes backwards.
    """

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        k, e, h = len(TAGS), EMBED, HIDDEN
        self.p = {
            "E": rng.normal(0, 0.5, (N_CLASSES, e)), "X": rng.normal(0, 0.3, (2, e, 4 * h)), "H": rng.normal(0, 0.3, (2, h, 4 * h)), "c": np.zeros((2, 1, 4 * h)),
            "O": rng.normal(0, 0.3, (2 * h, k)), "b": np.zeros(k), "T": np.zeros((k, k)), "s": np.zeros(k),
        }
        self.p["c"][:, :, :h] = 1
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states, (time, batch, both directions'); x: (time, batch, embedding)."""
        p, h = self.p, HIDDEN
        n, b, _ = x.shape
        given = np.stack([x, x[::-1]], 1) @ p["X"] + p["c"]
        given[..., : 3 * h] *= 0.5  # a sigmoid is a tanh of half its argument
        inner = p["H"].copy()
        inner[..., : 3 * h] *= 0.5
        state, cell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        out, steps = np.empty((n, 2, b, h), np.float32), []
        for t in range(n):
            a = np.tanh(given[t] + state @ inner)
            gates = 0.5 + 0.5 * a[..., : 3 * h]
            f, i, o, g = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :], a[..., 3 * h :]
            before, old = state, cell
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = out[t] = o * tc
            if keep:
                steps.append((before, gates, g, old, tc))
        return np.concatenate([out[:, 0], out[::-1, 1]], 2), steps

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores of windows; ids: (batch, time); result (time, batch, tags)."""
        return self._run(self.p["E"][ids.T], False)[0] @ self.p["O"] + self.p["b"]

    def _gradient(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of a batch of windows."""
        p, (b, n), h = self.p, ids.shape, HIDDEN
        x = p["E"][ids.T]
        hid, steps = self._run(x, True)
        u = hid @ p["O"] + p["b"]
        # Forward and backward sums of the CRF, scaled to one at each place.
        eu, et = np.exp(u - u.max(2, keepdims=True)), np.exp(p["T"])
        alpha, beta = np.empty_like(u), np.ones_like(u)
        alpha[0] = eu[0] * np.exp(p["s"])
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for t in range(1, n):
            a = (alpha[t - 1] @ et) * eu[t]
            alpha[t] = a / a.sum(1, keepdims=True)
        for t in range(n - 2, -1, -1):
            a = (eu[t + 1] * beta[t + 1]) @ et.T
            beta[t] = a / a.sum(1, keepdims=True)
        du = alpha * beta
        du /= du.sum(2, keepdims=True)
        np.add.at(du, (np.arange(n)[:, None], np.arange(b), tags.T), -1)
        g = {"s": du[0].sum(0) / b}
        left, right = alpha[:-1], eu[1:] * beta[1:]
        left = left / ((left @ et) * right).sum(2, keepdims=True)
        g["T"] = np.einsum("tbi,tbj->ij", left, right) * et
        np.add.at(g["T"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        g["T"] /= b
        du /= b
        g["O"], g["b"] = hid.reshape(-1, 2 * h).T @ du.reshape(-1, du.shape[2]), du.sum((0, 1))
        dh = du @ p["O"].T
        dh = np.stack([dh[..., :h], dh[::-1, :, h:]], 1)
        ds, dc, back = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32), p["H"].transpose(0, 2, 1)
        da = np.empty((n, 2, b, 4 * h), np.float32)
        for t in range(n - 1, -1, -1):
            _, gates, gg, old, tc = steps[t]
            f, i, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            s = dh[t] + ds
            dcell = dc + s * o * (1 - tc * tc)
            d = da[t]
            d[..., :h], d[..., h : 2 * h], d[..., 2 * h : 3 * h] = dcell * old, dcell * gg, s * tc
            d[..., : 3 * h] *= gates * (1 - gates)
            d[..., 3 * h :] = dcell * i * (1 - gg * gg)
            ds, dc = d @ back, dcell * f
        both = np.stack([x, x[::-1]], 1)
        g["X"], g["H"] = (np.stack([np.tensordot(v[:, k], da[:, k], ([0, 1], [0, 1])) for k in range(2)]) for v in (both, np.stack([q[0] for q in steps])))
        g["c"] = da.sum((0, 2))[:, None]
        dx = da @ p["X"].transpose(0, 2, 1)
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], ids.T, dx[:, 0] + dx[::-1, 1])
        return g

    def train(self, sentences: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02) -> BiLstmCrf:
        ids, tags = np.full((len(sentences), WINDOW), N_CLASSES - 1), np.zeros((len(sentences), WINDOW), int)
        for r, (text, spans) in enumerate(sentences):
            y = np.zeros(len(text), int)
            for a, b, kind in spans:
                y[a:b] = TAGS.index(f"I-{kind}")
                y[a] = TAGS.index(f"B-{kind}")
            m = min(WINDOW, len(text))
            ids[r, :m], tags[r, :m] = classes(text)[:m], y[:m]
        rng, m, v, step = np.random.default_rng(1), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(ids))
            for i in range(0, len(order), batch):
                step += 1
                g = self._gradient(ids[order[i : i + batch]], tags[order[i : i + batch]])
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k in self.p:
                    x = g[k] * min(1, 5 / (norm + 1e-9))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
                    change = rate * 0.85**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] = (self.p[k] - change).astype(np.float32)
        return self

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of windows and each position's score over the tag O."""
        u = self.scores(ids)
        n, b, k = u.shape
        best, back = u[0] + self.p["s"], np.empty((n, b, k), np.int8)
        for t in range(1, n):
            v = best[:, :, None] + self.p["T"]
            back[t] = v.argmax(1)
            best = u[t] + v.max(1)
        path = np.empty((b, n), int)
        path[:, -1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(b), path[:, t]]
        gain = np.take_along_axis(u.transpose(1, 0, 2), path[:, :, None], 2)[:, :, 0] - u[:, :, 0].T
        return path, gain


@cache
def trained() -> BiLstmCrf:
    """The model; trained once in a process, always to the same weights."""
    return BiLstmCrf(7).train(training_spans(TRAIN_SENTENCES, 11))


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all stretches that can hold a span."""
    out: list[tuple[int, int]] = []
    stretches: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if stretches and m.end() + MARGIN <= stretches[-1][1]:
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        while a > (stretches[-1][1] if stretches else 0) and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    for a, b in stretches:
        at = a
        while True:
            out.append((at, min(b, at + WINDOW)))
            if at + WINDOW >= b:
                break
            at += STEP
    return out


def reconcile(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The non-overlapping set of the largest total score; a span found twice counts once, by its best score."""
    best: dict[tuple[int, int, str], float] = {}
    for a, b, kind, score in spans:
        best[a, b, kind] = max(score, best.get((a, b, kind), 0.0))
    order = sorted((b, a, kind, s) for (a, b, kind), s in best.items() if s > 0)
    ends = np.array([x[0] for x in order])
    total, take = [0.0], []
    for i, (_, a, _, s) in enumerate(order):
        j = int(np.searchsorted(ends[:i], a, side="right"))
        take.append((total[j] + s > total[i], j))
        total.append(max(total[i], total[j] + s))
    out, i = [], len(order)
    while i:
        if take[i - 1][0]:
            b, a, kind, _ = order[i - 1]
            out.append((a, b, kind))
            i = take[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def decoded(texts: list[str], where: list[tuple[int, int, int]], model: BiLstmCrf, width: int = WINDOW) -> Iterator[tuple[int, int, int, str, float, bool]]:
    """``text, start, end, kind, score over O, cut`` of each span in each window (text, start, end); cut: by the window's edge."""
    for k in range(0, len(where), 512):
        part = where[k : k + 512]
        ids = np.full((len(part), width), N_CLASSES - 1)
        for r, (i, a, b) in enumerate(part):
            ids[r, : b - a] = classes(texts[i][a:b])
        path, gain = model.decode(ids)
        for r in np.flatnonzero(path.any(1)):
            i, a, b = part[r]
            tags, t = path[r], 0
            while t < b - a:
                if tags[t] == 0:
                    t += 1
                    continue
                kind, start = (tags[t] - 1) // 2, t
                t += 1
                while t < b - a and tags[t] == 2 * kind + 2:
                    t += 1
                yield i, a + start, a + t, KINDS[kind], float(gain[r, start:t].sum()), (start == 0 and a > 0) or (t == b - a and b < len(texts[i]))


def spans_of(texts: list[str], model: BiLstmCrf) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Base spans and all spans of each text, by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    again: set[tuple[int, int, int]] = set()
    todo = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)]
    width = WINDOW
    for turn in range(2 + (LONGEST // WINDOW).bit_length() - 1):
        wider = WINDOW if not turn else 2 * width
        for i, a, b, kind, score, cut in decoded(texts, todo, model, width):
            if cut and (not turn or kind == "email") and wider <= LONGEST:
                at = max(0, (a + b - wider) // 2)
                again.add((i, at, min(len(texts[i]), at + wider)))
            elif not cut and score >= SURE * (b - a) and plausible(texts[i][a:b], kind):
                found[i].append((a, b, kind, score))
        todo, width = sorted(again.difference(todo)), wider
        again = set()
    out = []
    for own, more in zip(base, found, strict=True):
        taken = sorted((a, b) for a, b, _ in own)
        reach = list(accumulate((b for _, b in taken), max))
        extra = [x for x in reconcile(more) if not (k := bisect_left(taken, (x[1],))) or reach[k - 1] <= x[0]]
        out.append((own, sorted(own + extra, key=lambda s: (KINDS.index(s[2]), s[0]))))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the base counts ``n_email n_ip n_card n_phone``, ``n_model`` (spans that the model adds), ``base_sha256, spans``.

    One narrow pass. The closure carries the model's weights, about 20 kB at any
    size of the data.
    """
    model = trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = spans_of(batch.column(1).to_pylist(), model)
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[2] == kind for s in own) for own, _ in both], pa.int64()) for kind in KINDS]
            columns += [pa.array([len(every) - len(own) for own, every in both], pa.int64())]
            columns += [pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own, _ in both], pa.string()), pa.array([written(every) for _, every in both], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, *(f"n_{k}" for k in KINDS), "n_model", "base_sha256", "spans"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_model long, base_sha256 string, spans string"
    return map_rows(df, [id_col, text_or_empty(text_col).alias("__text")], scan, schema)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))

"""Personal data by fixed rules and by a character-level bidirectional LSTM with CRF transitions.

The rules give the base spans. The network is trained in numpy on labelled spans: the base spans of a bounded sample
of documents, and further written forms (numbers without a country code, spelled-out or bracketed
addresses) put into texts of the sample. It reads characters as classes in both directions; a CRF over the tags
"none, email, ip, card, phone" decodes overlapping windows. A document's tags are put together from the windows, each
position taking the tag of the window in whose core it lies, so a span that runs across windows stays whole. A
decoded span is added if it passes the check of its kind and meets no base span; base spans are never changed.

All windows of a batch are run together, longest first; the gates are piecewise linear, which keeps a step cheap.

Null texts count as empty and have no spans. Repeated rows are repeated in the result. Rows without an id are read
too. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches, text_groups

EKINDS = ["email", "ip", "card", "phone"]
HIDDEN = 8
WINDOW, OVERLAP = 1024, 96
GROUP_CHARS = 2_000_000
ROWS, BLOCK = 2048, 32
SAMPLE_ROWS, SNIPPETS, SNIPPET_CHARS = 1500, 4, 80
ROUNDS, BATCH = 260, 192
Span = tuple[int, int, int]  # kind, start, end

# ---------------------------------------------------------------- rules

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        # the local part is the run before the sign: no earlier start can match, and none later is leftmost
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield 0, start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The rules' spans, by start and then kind."""
    spans = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                spans.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append((3, *m.span()))
    return sorted(spans, key=lambda s: (s[1], s[0]))


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{EKINDS[k]}:{a}:{b}" for k, a, b in spans)


_EMAIL_FORM = re.compile(
    r"[A-Za-z0-9._%+-]+ ?[\[(]?(?:@|(?<=[ \[(])at(?=[ \])]))[\])]? ?[A-Za-z0-9-]+(?: ?[\[(]?(?:\.|(?<=[ \[(])dot(?=[ \])]))[\])]? ?[A-Za-z0-9-]+)+")
_IP_FORM = re.compile(r"[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}")
_CARD_FORM = re.compile(r"[0-9]+(?:[ ./-][0-9]+)*")
_PHONE_FORM = re.compile(r"\+?\(?[0-9]+\)?(?:[ .-]?\(?[0-9]+\)?)*")


def checked(kind: int, text: str, start: int, end: int) -> Span | None:
    """A decoded span, trimmed, if it has the form of its kind and stands alone; else None."""
    while start < end and not (text[start].isalnum() or (kind == 3 and text[start] in "+(")):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    part = text[start:end]
    if end == start or text[start - 1:start].isalnum() or text[end:end + 1].isalnum():
        return None
    digits = "".join(c for c in part if c in "0123456789")
    fine = ((kind == 0 and _EMAIL_FORM.fullmatch(part)) or
            (kind == 1 and _IP_FORM.fullmatch(part) and all(int(n) <= 255 for n in re.findall("[0-9]+", part))) or
            (kind == 2 and 14 <= len(digits) <= 19 and _CARD_FORM.fullmatch(part) and luhn(digits)) or
            (kind == 3 and 10 <= len(digits) <= 15 and len(part) > len(digits) and _PHONE_FORM.fullmatch(part)))
    return (kind, start, end) if fine else None


# ---------------------------------------------------------------- network

_SHOWN = " \n\tabcdefghijklmnopqrstuvwxyz.,;:!?'\"()[]{}@_%+-*/\\=<>#&$|~^`"
CLASSES = len(_SHOWN) + 5
TAGS = len(EKINDS) + 1


def _class_table() -> np.ndarray:
    table = np.full(0x10000, len(_SHOWN), np.int64)
    for code in range(0x10000):
        if chr(code).isalpha():
            table[code] = len(_SHOWN) + 1
    for i, c in enumerate(_SHOWN):
        table[ord(c)] = i
    table[ord("A"):ord("Z") + 1] = len(_SHOWN) + 2
    table[ord("0"):ord("2") + 1] = len(_SHOWN) + 3
    table[ord("3"):ord("9") + 1] = len(_SHOWN) + 4
    return table


class Tagger:
    """Two LSTM passes with piecewise linear gates, an output layer, and transition scores between tags.

    Gates are kept in the order input, forget, output, candidate; the first three pass `clip(z, 0, 1)`, the
    candidate and the cell `clip(z, -1, 1)`. A change from one kind straight to another is not allowed.
    """

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for side in "fb":
            self.p["e" + side] = rng.normal(0, 0.3, (4 * hidden, CLASSES))
            self.p["e" + side][:3 * hidden] += 0.5
            self.p["w" + side] = rng.normal(0, 0.3 / np.sqrt(hidden), (4 * hidden, hidden))
            self.p["o" + side] = rng.normal(0, 0.5, (TAGS, hidden))
        self.p["bias"] = np.zeros((TAGS, 1))
        self.p["bias"][0] = 1.0
        self.p["step"] = np.zeros((TAGS, TAGS))
        self.allowed = np.ones((TAGS, TAGS), bool)
        self.allowed[1:, 1:] = np.eye(TAGS - 1, dtype=bool)
        self.table = _class_table()

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.table[np.minimum(codes, 0xFFFF)]

    # training

    def _pass(self, side: str, x: np.ndarray) -> dict:
        """Forward over x (steps, rows) of equal length; everything that the way back needs."""
        steps, rows = x.shape
        n = self.hidden
        e, w = self.p["e" + side], self.p["w" + side]
        z = np.empty((steps, 4 * n, rows))
        cell, out = np.zeros((steps + 1, n, rows)), np.zeros((steps + 1, n, rows))
        for t in range(steps):
            z[t] = e[:, x[t]] + w @ out[t]
            gate, candidate = np.clip(z[t, :3 * n], 0, 1), np.clip(z[t, 3 * n:], -1, 1)
            cell[t + 1] = gate[n:2 * n] * cell[t] + gate[:n] * candidate
            out[t + 1] = gate[2 * n:] * np.clip(cell[t + 1], -1, 1)
        return {"x": x, "z": z, "cell": cell, "out": out}

    def _back(self, side: str, saved: dict, down: np.ndarray) -> dict:
        """Gradients from `down` (steps, tags, rows), the gradient of the emissions."""
        n, z, cell, out = self.hidden, saved["z"], saved["cell"], saved["out"]
        w, o = self.p["w" + side], self.p["o" + side]
        steps, rows = saved["x"].shape
        d_out, d_cell = np.zeros((n, rows)), np.zeros((n, rows))
        dz = np.empty_like(z)
        for t in range(steps - 1, -1, -1):
            gate, candidate = np.clip(z[t, :3 * n], 0, 1), np.clip(z[t, 3 * n:], -1, 1)
            inner = np.clip(cell[t + 1], -1, 1)
            d_out = d_out + o.T @ down[t]
            d_cell = d_cell + d_out * gate[2 * n:] * _slope(cell[t + 1], -1)
            dz[t, :n] = d_cell * candidate * _slope(z[t, :n], 0)
            dz[t, n:2 * n] = d_cell * cell[t] * _slope(z[t, n:2 * n], 0)
            dz[t, 2 * n:3 * n] = d_out * inner * _slope(z[t, 2 * n:3 * n], 0)
            dz[t, 3 * n:] = d_cell * gate[:n] * _slope(z[t, 3 * n:], -1)
            d_cell = d_cell * gate[n:2 * n]
            d_out = w.T @ dz[t]
        flat = dz.transpose(1, 0, 2).reshape(4 * n, -1)
        d_e = np.zeros((CLASSES, 4 * n))
        np.add.at(d_e, saved["x"].ravel(), flat.T)
        before = out[:-1].transpose(1, 0, 2).reshape(n, -1)
        after = out[1:].transpose(1, 0, 2).reshape(n, -1)
        return {"e" + side: d_e.T, "w" + side: flat @ before.T,
                "o" + side: down.transpose(1, 0, 2).reshape(TAGS, -1) @ after.T}

    def _crf(self, emit: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the negative log likelihood by emissions and by transitions."""
        steps, _, rows = emit.shape
        move = np.where(self.allowed, np.exp(self.p["step"]), 0)
        grow = np.exp(emit - emit.max(axis=1, keepdims=True))
        alpha, beta = np.empty_like(grow), np.ones_like(grow)
        for t in range(steps):
            a = grow[t] * (move.T @ alpha[t - 1]) if t else grow[t]
            alpha[t] = a / a.sum(axis=0)
        for t in range(steps - 2, -1, -1):
            b = move @ (grow[t + 1] * beta[t + 1])
            beta[t] = b / b.sum(axis=0)
        mass = alpha * beta
        down = mass / mass.sum(axis=1, keepdims=True)
        right = grow[1:] * beta[1:]
        norm = np.einsum("tir,ij,tjr->tr", alpha[:-1], move, right, optimize=True)
        d_move = move * np.einsum("tir,tjr->ij", alpha[:-1] / norm[:, None], right, optimize=True)
        true = np.arange(TAGS)[:, None] == tags[:, None, :]
        np.subtract.at(d_move, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        return (down - true) / (steps * rows), d_move / (steps * rows)

    def fit(self, x: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH, rate: float = 0.03, seed: int = 5) -> None:
        """Adam on batches of snippets x and tags, both (snippets, characters)."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for r in range(1, rounds + 1):
            chosen = rng.integers(0, len(x), batch)
            xs, ts = x[chosen].T, tags[chosen].T
            saved = {"f": self._pass("f", xs), "b": self._pass("b", xs[::-1])}
            emit = (np.matmul(self.p["of"], saved["f"]["out"][1:]) + np.matmul(self.p["ob"], saved["b"]["out"][1:])[::-1]
                    + self.p["bias"])
            down, d_step = self._crf(emit, ts)
            grad = {**self._back("f", saved["f"], down), **self._back("b", saved["b"], down[::-1]),
                    "bias": down.sum(axis=(0, 2))[:, None], "step": d_step}
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            slow = rate * min(1.0, 2 - 2 * r / rounds + 0.05)
            for k, g in grad.items():
                g = g * min(1.0, 0.1 / (size + 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= slow * (first[k] / (1 - 0.9 ** r)) / (np.sqrt(second[k] / (1 - 0.99 ** r)) + 1e-7)

    # decoding

    def _emissions(self, x: np.ndarray, live: np.ndarray) -> list[np.ndarray]:
        """Emissions of windows x (steps, rows), as blocks of BLOCK steps (steps, tags, rows alive in the block).

        Positions behind a window's end hold the class PAD, which closes all gates, so states stay zero there.
        """
        steps, n = len(x), self.hidden
        emit: list[np.ndarray] = []
        starts = list(range(0, steps, BLOCK))
        for side in "fb":
            e, w, o = (np.ascontiguousarray(self.p[k + side], np.float32) for k in "ewo")
            e = np.concatenate([e, np.full((4 * n, 1), -1e4, np.float32)], axis=1)
            cell = out = np.zeros((n, 0), np.float32)
            for at in starts if side == "f" else starts[::-1]:
                k, end = int(live[at]), min(at + BLOCK, steps)
                cell, out = _resized(cell, k), _resized(out, k)
                z, y, u = np.empty((4 * n, k), np.float32), np.empty((4 * n, k), np.float32), np.empty((n, k), np.float32)
                gates, candidate = z[:3 * n], z[3 * n:]
                history = np.empty((end - at, n, k), np.float32)
                for t in range(at, end) if side == "f" else range(end - 1, at - 1, -1):
                    np.take(e, x[t, :k], axis=1, out=z, mode="clip")
                    np.matmul(w, out, out=y)
                    np.add(z, y, out=z)
                    np.clip(gates, 0, 1, out=gates)
                    np.clip(candidate, -1, 1, out=candidate)
                    np.multiply(cell, z[n:2 * n], out=cell)
                    np.multiply(z[:n], candidate, out=u)
                    np.add(cell, u, out=cell)
                    out = history[t - at]
                    np.clip(cell, -1, 1, out=out)
                    np.multiply(out, z[2 * n:3 * n], out=out)
                if side == "f":
                    emit.append(np.matmul(o, history))
                else:
                    emit[at // BLOCK] += np.matmul(o, history)
        bias = self.p["bias"].astype(np.float32)
        for block in emit:
            block += bias
        return emit

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of windows x (steps, rows), longest first: (rows with any span, tags (those rows, steps))."""
        steps, rows = x.shape
        live = np.searchsorted(-lengths, -np.arange(steps + 1), side="left")
        step = self.p["step"].astype(np.float32)
        enter, leave, stay = step[0, 1:, None], step[1:, 0, None], np.ascontiguousarray(np.diagonal(step)[1:, None])
        entered = np.zeros((steps, TAGS - 1, rows), bool)
        left = np.zeros((steps, rows), np.int8)  # the kind, from 1, that was left for none at this step
        last, ended = np.zeros(rows, np.int64), np.zeros(rows, bool)
        best = np.empty((TAGS, 0), np.float32)
        for number, emit in enumerate(self._emissions(x, live)):
            k, at = emit.shape[2], number * BLOCK
            best = _resized(best, k) if at else np.zeros((TAGS, k), np.float32)
            none, kinds = best[0], best[1:]
            inside, fresh, top, gone = np.empty_like(kinds), np.empty_like(kinds), np.empty_like(none), np.empty(k, bool)
            for t in range(at, at + len(emit)):
                if t == 0:
                    best += emit[0]
                else:
                    np.add(kinds, leave, out=inside)
                    np.max(inside, axis=0, out=top)
                    np.add(none, enter, out=fresh)
                    np.add(none, step[0, 0], out=none)
                    np.greater(top, none, out=gone)
                    if gone.any():
                        some = np.flatnonzero(gone)
                        left[t, some] = inside[:, some].argmax(axis=0) + 1
                        ended[some] |= lengths[some] > t
                        none[some] = top[some]
                    np.add(kinds, stay, out=kinds)
                    np.greater(fresh, kinds, out=entered[t, :, :k])
                    np.maximum(kinds, fresh, out=kinds)
                    np.add(best, emit[t - at], out=best)
                if live[t + 1] < live[t]:
                    over = slice(live[t + 1], live[t])
                    last[over] = best[:, over].argmax(axis=0)
        some = np.flatnonzero((last > 0) | ended)
        tags = np.zeros((len(some), steps), np.int8)
        state = np.zeros(len(some), np.int64)
        for t in range(steps - 1, -1, -1):
            ends = lengths[some] - 1 == t
            state[ends] = last[some[ends]]
            here = lengths[some] > t
            tags[here, t] = state[here]
            was = left[t, some]
            come = entered[t, np.maximum(state - 1, 0), some] & (state > 0)
            state = np.where(here, np.where(state == 0, was, np.where(come, 0, state)), state)
        return some, tags

    def spans(self, texts: Sequence[str]) -> list[list[Span]]:
        """The decoded spans of each text, put together from overlapping windows."""
        found: list[list[Span]] = [[] for _ in texts]
        codes = [self.classes(t) for t in texts]
        doc, start, size = [], [], []
        for i, c in enumerate(codes):
            for at in range(0, max(1, len(c) - OVERLAP), WINDOW - OVERLAP):
                doc.append(i)
                start.append(at)
                size.append(min(WINDOW, len(c) - at))
        doc, start, size = np.array(doc, np.int64), np.array(start, np.int64), np.array(size, np.int64)
        first = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        flat = np.concatenate([*codes, np.zeros(1, np.int64)])
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for at in range(0, len(order), ROWS):
            part = order[at:at + ROWS]
            steps = int(size[part[0]])
            place = (first[doc[part]] + start[part])[None, :] + np.arange(steps)[:, None]
            x = flat[np.minimum(place, len(flat) - 1)]
            x[np.arange(steps)[:, None] >= size[part]] = CLASSES  # PAD
            some, tags = self.decode(x, size[part])
            for w, row in zip(part[some].tolist(), tags, strict=True):
                length = len(codes[doc[w]])
                low = 0 if start[w] == 0 else OVERLAP // 2
                high = int(size[w]) if start[w] + size[w] == length else int(size[w]) - OVERLAP // 2
                edge = np.flatnonzero(np.diff(np.concatenate([[0], row[low:high], [0]])))
                for a, b in zip(edge, edge[1:], strict=False):
                    if row[low + a]:
                        runs.setdefault(int(doc[w]), []).append((int(start[w]) + low + int(a), int(start[w]) + low + int(b), int(row[low + a]) - 1))
        for i, parts in runs.items():
            for a, b, kind in sorted(parts):
                if found[i] and found[i][-1][0] == kind and found[i][-1][2] == a:
                    found[i][-1] = (kind, found[i][-1][1], b)  # goes on in the next window's core
                else:
                    found[i].append((kind, a, b))
        return found

    def all_spans(self, texts: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text."""
        out = []
        for text, decoded in zip(texts, self.spans(texts), strict=True):
            base = base_spans(text)
            every = list(base)
            for kind, a, b in decoded:
                span = checked(kind, text, a, b)
                if span and all(span[2] <= s[1] or s[2] <= span[1] for s in every):
                    every.append(span)
            out.append((base, sorted(every, key=lambda s: (s[1], s[0])) if len(every) > len(base) else base))
        return out


def _resized(state: np.ndarray, rows: int) -> np.ndarray:
    """The state of the first `rows` windows; those that were not there yet start from zero."""
    if state.shape[1] >= rows:
        return np.ascontiguousarray(state[:, :rows])
    return np.concatenate([state, np.zeros((len(state), rows - state.shape[1]), state.dtype)], axis=1)


def _slope(z: np.ndarray, low: float) -> np.ndarray:
    """Slope of clip(z, low, 1), with a little left outside so that a closed gate can open again."""
    return np.where((z > low) & (z < 1), 1.0, 0.02)


# ---------------------------------------------------------------- labelled spans

def tag_row(text: str, spans: Sequence[Span]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        tags[max(a, 0):max(b, 0)] = kind + 1
    return tags


def snippets(text: str, rng: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """Up to SNIPPETS pieces of a text around its base spans, and one from anywhere."""
    spans = base_spans(text)
    chosen = [spans[i] for i in sorted(rng.permutation(len(spans))[:SNIPPETS])]
    starts = [max(0, s[1] - int(rng.integers(0, SNIPPET_CHARS // 2))) for s in chosen]
    starts.append(int(rng.integers(0, max(1, len(text) - SNIPPET_CHARS))))
    return [(text[a:a + SNIPPET_CHARS], [(k, max(s - a, 0), min(e - a, SNIPPET_CHARS)) for k, s, e in spans
                                         if s < a + SNIPPET_CHARS and e > a]) for a in starts]


def written_form(rng: np.random.Generator) -> tuple[int, str]:
    """A made-up piece of personal data in one of several written forms; kind -1 is a look-alike."""
    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word(low: int, high: int) -> str:
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(low, high))))

    def card() -> str:
        body = "4" + number(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    name, site, end = word(2, 9) + str(rng.choice(["", "." + word(2, 6), number(2)])), word(3, 9), str(rng.choice(["com", "org", "net", "de"]))
    parts = [str(n) for n in rng.integers(1, 256, 4)]
    c = card()
    fours = [c[i:i + 4] for i in range(0, 16, 4)]
    forms = [(0, f"{name}@{site}.{end}"), (0, f"{name} at {site} dot {end}"), (0, f"{name}[at]{site}.{end}"), (0, f"{name} (at) {site}.{end}"),
             (1, ".".join(parts)), (1, "[.]".join(parts)), (2, c), (2, " ".join(fours)), (2, ".".join(fours)), (2, "/".join(fours)),
             (3, f"+{number(2)} {number(3)} {number(7)}"), (3, f"({number(3)}) {number(3)}-{number(4)}"), (3, f"{number(3)}-{number(3)}-{number(4)}"),
             (3, f"+1 ({number(3)}) {number(3)}-{number(4)}"), (-1, f"20{number(2)}-0{number(1)}-1{number(1)}"), (-1, f"version {number(1)}.{number(1)}"),
             (-1, f'"{"".join(rng.choice(list("0123456789abcdef"), 40))}"'), (-1, f"#{number(6)}"), (-1, f"{number(2)}:{number(2)}"), (-1, f"at {word(3, 8)}"),
             (-1, f"${number(3)},{number(3)}.{number(2)}"), (-1, f"{word(2, 8)}: {word(2, 6)}")]
    return forms[int(rng.integers(0, len(forms)))]


def with_written_forms(pool: list[tuple[str, list[Span]]], rng: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """Snippets without spans, each with a made-up form put between two words."""
    out = []
    for text, spans in pool:
        if spans or " " not in text:
            continue
        gaps = [i for i, c in enumerate(text) if c == " "]
        at = gaps[int(rng.integers(0, len(gaps)))] + 1
        kind, form = written_form(rng)
        mixed = text[:at] + form + str(rng.choice([" ", ". ", ", ", "\n"])) + text[at:]
        cut = max(0, min(at - 20, len(mixed) - SNIPPET_CHARS))
        out.append((mixed[cut:cut + SNIPPET_CHARS], [(kind, at - cut, min(at - cut + len(form), SNIPPET_CHARS))] if kind >= 0 else []))
    return out


def fit_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Tagger | None:
    """A tagger fitted on at most `sample_rows` documents with digits or an at sign, and as many of all documents, the
    first by a hash of the id; None if there are no texts. An id gives one text, and a text SNIPPETS + 1 snippets at most."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND length(text) > 0")
    order = [F.xxhash64("id"), F.col("id")]
    marked = rows.filter(F.col("text").rlike("[0-9@]")).select("id").distinct().orderBy(*order).limit(sample_rows)
    others = rows.select("id").distinct().orderBy(*order).limit(sample_rows)
    chosen = F.broadcast(marked.union(others).distinct())  # at most 2 * sample_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng(abs(hash(number)) if not isinstance(number, str) else list(number.encode()))
                out += [(piece, [x for s in spans for x in s]) for piece, spans in snippets(text, rng)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()),
                                              pa.array([o[1] for o in out], pa.list_(pa.int64()))], ["piece", "spans"])

    one = rows.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"))
    found = one.mapInArrow(run, "piece STRING, spans ARRAY<BIGINT>").collect()
    pool = sorted({(r.piece, tuple(zip(*[iter(r.spans)] * 3, strict=True))) for r in found})
    if not pool:
        return None
    pool = [(text, list(spans)) for text, spans in pool]
    rng = np.random.default_rng(11)
    plain = [p for p in pool if not p[1]]
    for _ in range(max(1, 4000 // max(1, len(plain)))):
        pool += with_written_forms(plain, rng)
    tagger = Tagger()
    x = np.zeros((len(pool), SNIPPET_CHARS), np.int64)
    tags = np.zeros((len(pool), SNIPPET_CHARS), np.int64)
    for i, (text, spans) in enumerate(pool):
        x[i, :len(text)] = tagger.classes(text)
        tags[i, :len(text)] = tag_row(text, spans)[:len(text)]
    # the same number of snippets of every kind, with and without spans
    kind = tags.max(axis=1)
    level = np.concatenate([rng.choice(np.flatnonzero(kind == k), 1600) for k in np.unique(kind)])
    tagger.fit(x[level], tags[level])
    return tagger


def find_spans(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base spans and all spans as arrays of (kind, start, end); code points, end exclusive."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def column(spans: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": EKINDS[k], "start": a, "end": b} for k, a, b in s] for s in spans], pa.list_(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), []
            for a, b in text_groups(texts, GROUP_CHARS):
                found += tagger.all_spans(texts[a:b]) if tagger else [(base_spans(t),) * 2 for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0), column([f[0] for f in found]), column([f[1] for f in found])],
                                             [id_col, "base", "spans"])

    array = "ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT>>"
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).mapInArrow(
        run, f"`{id_col}` {kind}, base {array}, spans {array}")


def mask(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the union goes."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"<{EKINDS[kind]}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with all spans masked in the text; a null text stays null."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            held = [t or "" for t in texts]
            done: list[str] = []
            for a, b in text_groups(held, GROUP_CHARS):
                found = tagger.all_spans(held[a:b]) if tagger else [(base_spans(t),) * 2 for t in held[a:b]]
                done += [mask(t, f[1]) for t, f in zip(held[a:b], found, strict=True)]
            new = pa.array([None if t is None else d for t, d in zip(texts, done, strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)

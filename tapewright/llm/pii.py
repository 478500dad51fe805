"""Personal data: fixed patterns, plus a linear-chain conditional random field over word-shape features, trained from
a small labelled table and decoded by Viterbi in numpy batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tapewright.llm import textnum as tn
from tapewright.llm.store import fresh

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the random field: also passwords, keys and tokens, which have no fixed pattern.
FOUND = (*KINDS, "secret")
LABELS = ["O", *(f"{p}-{k}" for k in FOUND for p in "BI")]
#: A word farther than this from a trigger word (a digit, @, a dot inside, 16 capitals, a bracketed "at" or "dot", "dot") is O: a
#: constraint of the model, which decoding keeps exactly.
REACH = 3
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts at the first digit of a run: later digits of the run can do no better.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[\[({](at|dot)[\])}]|dot", re.I)
_DIGIT = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans: leftmost, non-overlapping per kind, failing matches dropped; by kind, then start."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        m, start = _DOMAIN.match(text, at), at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            out.append(("email", start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    # int() of a long run of digits is slow: four significant digits are enough to be over 255.
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() < 40 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- features

_TAIL = re.compile(r"[.,;:!?%$#*&\"'>\]}]+$")
_HEAD = re.compile(r"^[\"'<\[{*#$%&]+")
_RUNS = re.compile(r"[0-9]+|[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|.", re.S)
CUES = frozenset("phone tel telephone call fax mobile cell email e-mail mail contact ip address host server card visa account at dot (at) (dot) [at] [dot] com org net edu example password passwd token secret key = order item page version year id ref no".split())


def shape(word: str) -> str:
    """Runs of lower-case, upper-case letters as a, A, of digits as d with the run's length, up to 8; other characters
    as they are. Of a word of over 64 characters: which of these it has."""
    if len(word) > 64:
        return "long" + "".join(n for n, x in (("a", "[a-zß-öø-ÿ]"), ("A", "[A-ZÀ-ÖØ-Þ]"), ("d", "[0-9]"), ("-", "[^a-zß-öø-ÿA-ZÀ-ÖØ-Þ0-9]")) if re.search(x, word))
    parts = []
    for run in _RUNS.findall(word):
        c = run[0]
        parts.append(f"d{min(len(run), 8)}" if c in "0123456789" else "a" if c.islower() else "A" if c.isupper() else c)
    return "".join(parts)


_HEX, _UPPER, _MIXED = re.compile("[0-9a-f]{16,}|[0-9A-F]{16,}"), re.compile("[0-9A-Z]{16,}"), re.compile("[0-9A-Za-z_-]{16,}")
#: Access key ids, public form, which may have no digit.
_NO_DIGIT = re.compile("(AKIA|ASIA)[A-Z2-7]{16}")
_SET = re.compile(r"[A-Za-z_]+[=:]([^=:]{8,})")


def key_like(word: str, digits: int) -> str:
    """What kind of key a word looks like: letters and digits, at least 16, or a value of at least 8 behind a name."""
    if not digits:
        return "upper" if _UPPER.fullmatch(word) else "_"
    if m := _SET.fullmatch(word):
        return "set-" + ("hex" if _HEX.fullmatch(m[1]) else "any")
    if digits == len(word):
        return "_"
    return "hex" if _HEX.fullmatch(word) else "upper" if _UPPER.fullmatch(word) else "mixed" if _MIXED.fullmatch(word) else "_"


def core(word: str) -> tuple[int, int]:
    """The word's place without quotes and punctuation around it."""
    a = m.end() if (m := _HEAD.match(word)) else 0
    b = m.start() if (m := _TAIL.search(word)) else len(word)
    return (a, b) if a < b else (0, len(word))


def features(words: list[str], lo: int = 0, hi: int | None = None) -> list[list[str]]:
    """Of the words [lo, hi), with the ones around them as neighbours."""
    hi = len(words) if hi is None else hi
    cores = [w[slice(*core(w))] for w in words]
    shapes = ["<", *(shape(w) for w in cores), ">"]
    cues = ["<", *(c if (c := w.lower().strip(":")) in CUES else "_" for w in cores), ">"]
    out = []
    for i in range(lo + 1, hi + 1):
        w = cores[i - 1]
        d = _digits(w)
        k = key_like(w, len(d))
        out.append([
            f"s={shapes[i]}", f"p={shapes[i - 1]}", f"n={shapes[i + 1]}", f"sp={shapes[i - 1]}|{shapes[i]}", f"sn={shapes[i]}|{shapes[i + 1]}", f"c={cues[i]}",
            f"cp={cues[i - 1]}", f"cn={cues[i + 1]}", f"cpn={cues[i - 1]}|{cues[i + 1]}", f"d={min(len(d), 20) if k == '_' else k}", f"l={len(d) >= 16 and luhn(d)}", f"@={'@' in w}", f"k={k}",
        ])
    return out


# --- the small labelled table

_PLAIN = "the report was sent by our team on monday and it covers several new topics der und la les una para mention thing of with from in to as please see".split()
#: Templates: {kind} is replaced with a made-up value of the kind, {_} with a plain word, the rest stays.
TEMPLATE_ROWS = (
    "{_} {phone} {_}", "call {phone} {_} {_}", "tel: {phone}", "{_} {_} phone {phone} .", "{email} {_} {_}", "{_} contact {email} {_}", "mail {email}", "{_} {ip} {_}",
    "server {ip} {_}", "host {ip} {_} {_}", "{_} card {card} {_}", "{_} {card} {_}", "{_} {_} {_} {_}", "{_} at {_} dot {_}", "{_} {number} {_}", "order {number} {_}",
    "{_} {year} {_}", "page {number} {_} {_}", "version {version} {_}", "{_} {version} {_}", "{_} {name.word} {_}", "id {short} {_}", "{_} {long} {_}", "account {long} {_}",
    "{_} {date} {_}", "{_} {time} {_}", "ref {long}", "{_} ( {number} ) {_}", "{_} @ {_} {_}", "{_} {money} {_}", "{_} {handle} {_}", "no {number} {year} {number} {_}", "{_} {junk} {_}",
    "{_} {secret} {_}", 'token = {secret} {_}', "{_} {_} {secret} {_}", "{secret} {_} {_}", "{_} key {secret}", "{_} {phone} {card} {_}", "{email} {_} {phone} {card} {_}", "{_} {ip} {_} {card} {_}",
)


def labelled_table(rows: int = 1200, seed: int = 17) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of made-up short sentences: values as the fixed patterns miss them (no plus sign, spelled-out
    addresses, dotted card groups) and as they don't, passwords and keys, and numbers, words and dates that are none of
    these."""
    r = np.random.default_rng(seed)
    num = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    pick = lambda *x: x[r.integers(len(x))]
    name = lambda: pick(*_PLAIN) + pick("", "", num(2))
    some = lambda letters, a, b: "".join(r.choice(list(letters), r.integers(a, b)))

    def card() -> str:
        d = str(r.integers(3, 7)) + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick("", ".", ".").join([d[i : i + 4] for i in range(0, 16, 4)])

    def long() -> str:
        d = num(r.integers(16, 21))
        return d if not luhn(d) else long()

    host = lambda: [pick(*_PLAIN), pick("com", "org", "net", "example")]
    made = {
        "phone": lambda: pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)} {num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}"),
        "email": lambda: (lambda h: pick(f"{name()}@{h[0]}.{h[1]}", f"{name()} (at) {h[0]} (dot) {h[1]}", f"{name()} [at] {h[0]} [dot] {h[1]}", f"{name()}(at){h[0]}.{h[1]}", f"{name()} (at) {h[0]}.{h[1]}", f"{name()} at {h[0]}.{h[1]}", f"{name()} at {h[0]} dot {h[1]}"))(host()),
        "ip": lambda: pick(".", ".", ".", ":").join(str(x) for x in r.integers(1, 256, 4)) if r.random() < 0.8 else ".".join(str(x) for x in r.integers(1, 256, 4)) + ":" + num(4),
        "card": card, "number": lambda: num(r.integers(1, 8)), "year": lambda: "19" + num(2), "version": lambda: ".".join(num(1) for _ in range(r.integers(2, 4))),
        "short": lambda: some("0123456789abcdef", 4, 9), "name": lambda: pick(*_PLAIN), "long": long,
        "secret": lambda: pick('"' + some("0123456789abcdef", 24, 44) + '"', pick("AKIA", "KEY", "SK") + some(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 16, 24), pick("password=", "token=", "secret:", "key=") + some("0123456789abcdef", 12, 40), pick("password=", "passwd:") + some("abcdefghijkmnpqrstuvwxyzABCDEFGHKLMNP23456789", 8, 14)), "date": lambda: pick(f"19{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}.0{num(1)}.19{num(2)}"),
        "time": lambda: f"1{num(1)}:{num(2)}", "money": lambda: pick(f"${num(3)}", f"{num(1)},{num(3)}", f"{num(2)}.{num(2)}"), "handle": lambda: "@" + name(), "junk": lambda: pick("4.0.", "2.0.", "3.", "###", "***"),
    }
    out = []
    for i in range(rows):
        words, labels = [], []
        for part in TEMPLATE_ROWS[i % len(TEMPLATE_ROWS)].split():
            kind = part.strip("{}") if part[0] == "{" else ""
            value = f"{name()}.{pick(*_PLAIN)}" if "." in kind else pick(*_PLAIN) if kind == "_" else made[kind]() if kind else part
            new = value.split()
            words += new
            labels += [f"{'B' if j == 0 else 'I'}-{kind}" if kind in FOUND else "O" for j in range(len(new))]
        if r.random() < 0.2:
            words[-1] += pick(".", ",", "!!", "###", "%%%")
        out.append((words, labels))
    return out


# --- the model


@dataclass
class Crf:
    places: dict[str, int]
    emit: np.ndarray
    trans: np.ndarray

    def scores(self, words: list[str], lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Of the words [lo, hi). With neighbours on a side, the word there is O: the step from or to it is added."""
        hi = len(words) if hi is None else hi
        e = np.array([self.emit[[self.places[f] for f in row if f in self.places]].sum(0) for row in features(words, lo, hi)])
        if lo > 0:
            e[0] += self.trans[0]
        if hi < len(words):
            e[-1] += self.trans[:, 0]
        return e

    def decode(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequences, by Viterbi over all segments at once, padded to the longest of similar ones."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(segments)
        order = np.argsort([len(s) for s in segments], kind="stable")
        for at in range(0, len(order), 512):
            rows = order[at : at + 512]
            n = np.array([len(segments[i]) for i in rows])
            e = np.zeros((len(rows), n.max(), len(LABELS)))
            for k, i in enumerate(rows):
                e[k, : n[k]] = segments[i]
            best, back = e[:, 0] + _FIRST, np.zeros(e.shape, int)
            kept = [best]
            for t in range(1, e.shape[1]):
                step = best[:, :, None] + self.trans
                back[:, t] = step.argmax(1)
                best = step.max(1) + e[:, t]
                kept.append(best)
            for k, i in enumerate(rows):
                path = [int(kept[n[k] - 1][k].argmax())]
                for t in range(n[k] - 1, 0, -1):
                    path.append(int(back[k, t, path[-1]]))
                out[i] = np.array(path[::-1])
        return out


_ALLOWED = np.array([[b[0] != "I" or a[1:] == b[1:] for b in LABELS] for a in LABELS])
_FIRST = np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)


@dataclass
class Sentences:
    """The labelled table as arrays: feature places (sentence, word, feature), labels, and which words there are."""

    ids: np.ndarray
    gold: np.ndarray
    real: np.ndarray


def sentences(table: list[tuple[list[str], list[str]]]) -> tuple[Sentences, dict[str, int]]:
    rows = [features(w) for w, _ in table]
    places: dict[str, int] = {}
    for f in (f for row in rows for word in row for f in word):
        places.setdefault(f, len(places))
    n, longest, width = len(table), max(len(r) for r in rows), max(len(w) for r in rows for w in r)
    ids, gold = np.full((n, longest, width), len(places)), np.zeros((n, longest), int)
    for i, (row, (_, labels)) in enumerate(zip(rows, table, strict=True)):
        for t, (word, label) in enumerate(zip(row, labels, strict=True)):
            ids[i, t, : len(word)] = [places[f] for f in word]
            gold[i, t] = LABELS.index(label)
    return Sentences(ids, gold, np.arange(longest) < np.array([len(r) for r in rows])[:, None]), places


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


_WALL = np.where(_ALLOWED, 0.0, -1e4)


def likelihood(emit: np.ndarray, trans: np.ndarray, data: Sentences) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of the labels and its gradients, by forward-backward over all sentences at once. The last row
    of ``emit`` stands for no feature."""
    ids, gold, real = data.ids, data.gold, data.real
    n, longest, width = ids.shape
    k = len(LABELS)
    onehot = np.eye(k)[gold] * real[..., None]
    pairs = np.einsum("nta,ntb->ab", onehot[:, :-1], onehot[:, 1:])
    e, t_ = emit[ids].sum(2), trans + _WALL
    fw, bw = np.zeros((n, longest, k)), np.zeros((n, longest, k))
    fw[:, 0] = e[:, 0] + _FIRST
    for t in range(1, longest):
        fw[:, t] = np.where(real[:, t, None], _lse(fw[:, t - 1, :, None] + t_, 1) + e[:, t], fw[:, t - 1])
    for t in range(longest - 2, -1, -1):
        bw[:, t] = np.where(real[:, t + 1, None], _lse(t_ + (e[:, t + 1] + bw[:, t + 1])[:, None, :], 2), 0)
    z = _lse(fw[:, -1], 1)
    marginal = np.exp(fw + bw - z[:, None, None]) * real[..., None]
    both = np.exp(fw[:, :-1, :, None] + t_ + (e[:, 1:] + bw[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
    left = np.repeat((onehot - marginal).reshape(-1, k), width, axis=0)
    g_emit = np.stack([np.bincount(ids.ravel(), left[:, c], len(emit)) for c in range(k)], 1)
    g_emit[-1] = 0
    value = ((e * onehot).sum() + (_FIRST * onehot[:, 0]).sum() + (t_ * pairs).sum() - z.sum()) / n
    return float(value), g_emit / n, np.where(_ALLOWED, (pairs - both.sum((0, 1))) / n, 0.0)


def train(table: list[tuple[list[str], list[str]]], steps: int = 60, rate: float = 0.3, decay: float = 2e-3) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam steps; one start for all runs."""
    data, places = sentences(table)
    k = len(LABELS)
    weights = [np.zeros((len(places) + 1, k)), np.zeros((k, k))]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in weights]
    for step in range(1, steps + 1):
        _, *grads = likelihood(*weights, data)
        for x, g, (m, v) in zip(weights, grads, moments, strict=True):
            g = g - decay * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(places, weights[0][:-1], np.where(_ALLOWED, weights[1], -1e4))


@lru_cache(1)
def default_model() -> Crf:
    return train(labelled_table())


def _plausible(kind: str, text: str) -> bool:
    """What a value of the kind has at least."""
    d = _digits(text)
    return {
        "email": ("@" in text or "at" in text.lower()) and ("." in text or "dot" in text.lower()) and not text.startswith("@"),
        "ip": len(p := re.findall("[0-9]+", text)) >= 4 and all(int(x) <= 255 for x in p[:4]),
        "card": 16 <= len(d) <= 19 and luhn(d),
        "phone": 8 <= len(d) <= 15,
        "secret": len(text) >= 12 and bool(d) or bool(_NO_DIGIT.fullmatch(text)),
    }[kind]


def _find(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            for part in tn.slices(batch, batch.schema.names[-1]):
                texts = part.column(part.num_columns - 1)
                words = tn.Words(texts)
                is_mark = (words.data >= 0x30) & (words.data <= 0x39) | (words.data == 0x40)
                marks = np.concatenate([[0], np.cumsum(is_mark)])
                base = [base_spans(texts[d].as_py()) if marks[words.off[d + 1]] > marks[words.off[d]] else [] for d in range(part.num_rows)]
                added = _added(model, words, marks, base)
                every = [sorted(b + a, key=lambda s: (FOUND.index(s[0]), s[1], s[2])) for b, a in zip(base, added, strict=True)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in x], kind) for x in (base, every)]
                yield pa.record_batch([*part.columns[:-1], *cols], names=[*part.schema.names[:-1], "base", "spans"])

    return run


def _added(model: Crf, words: tn.Words, marks: np.ndarray, base: list) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in base]
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return out
    hot = marks[ends] > marks[starts]
    lead = data[starts]
    # Long words of capitals and digits.
    capitals = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A) | (data >= 0x30) & (data <= 0x39))])
    hot |= (ends - starts >= 16) & (capitals[ends] - capitals[starts] >= 16)
    # Dots between other bytes of a word.
    dots = np.flatnonzero(data == 0x2E)
    word = np.searchsorted(starts, dots, "right") - 1
    hot[word[(dots > starts[word]) & (dots < ends[word] - 1)]] = True
    cue = ((ends - starts == 4) | (ends - starts == 5)) & np.isin(lead, [0x28, 0x5B, 0x7B])
    cue |= (ends - starts == 3) & (lead | 0x20 == 0x64)
    for w in np.flatnonzero(cue & ~hot).tolist():
        hot[w] = bool(_CUE.fullmatch(data[starts[w] : ends[w]].tobytes().decode()))
    at = np.flatnonzero(hot)
    if not len(at):
        return out
    doc = np.searchsorted(words.hi, at, "right")
    lo, hi = np.maximum(at - REACH, words.lo[doc]), np.minimum(at + REACH + 1, words.hi[doc])
    # Segments that touch are one. The words between them are O by the model's constraint, so each segment, with its real
    # neighbours and the steps from and to O, is decoded as it would be within its whole text.
    new = np.flatnonzero(np.concatenate([[True], (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = lo[new], np.maximum.reduceat(hi, new)
    before, after = first > words.lo[doc[new]], last < words.hi[doc[new]]
    for k in range(0, len(new), 2048):
        texts, scores = [], []
        for a, b, p, q in zip(*(x[k : k + 2048].tolist() for x in (first, last, before, after)), strict=True):
            wide = [data[starts[w] : ends[w]].tobytes().decode() for w in range(a - p, b + q)]
            texts.append(wide[p : p + b - a])
            scores.append(model.scores(wide, int(p), int(p) + b - a))
        for s, (tokens, path) in enumerate(zip(texts, model.decode(scores), strict=True)):
            d, a = int(doc[new[k + s]]), int(first[k + s])
            i = 0
            while i < len(path):
                if LABELS[path[i]][0] != "B":
                    i += 1
                    continue
                kind, j = LABELS[path[i]][2:], i + 1
                while j < len(path) and LABELS[path[j]] == f"I-{kind}":
                    j += 1
                head, tail = core(tokens[i])[0], core(tokens[j - 1])[1]
                begin = int(starts[a + i]) + len(tokens[i][:head].encode())
                end = int(starts[a + j - 1]) + len(tokens[j - 1][:tail].encode())
                i = j
                text = data[begin:end].tobytes().decode()
                if _plausible(kind, text):
                    off = int(words.off[d])
                    x, y = (int(np.count_nonzero((data[off:p] & 0xC0) != 0x80)) for p in (begin, end))
                    if all(y <= b or x >= e for _, b, e in base[d]):
                        out[d].append((kind, x, y))
    return out


def find_personal_data(docs: DataFrame, text_col: str = "text", table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (kind, start, end; code points, end exclusive) instead of its text.

    ``base`` has the fixed patterns' spans, ``spans`` these and those that the random field adds (also of the kind
    ``secret``: passwords, keys, tokens): label runs that do not overlap a base span and have what the kind needs (digits,
    Luhn). The field is trained on the driver from ``table`` (by default ``labelled_table()``, a fixed small one, once). By
    its constraint a word may be labelled only within three words of one with a digit, an @, a dot inside, 16 capitals or a
    spelled-out "at" or "dot"; whole texts are decoded, row by row, the words between as O.

    Null text counts as empty: no spans. Repeated rows get the same spans; an empty table gives an empty result.
    Columns named ``base`` or ``spans``, in any case, are replaced."""
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), "base", "spans")]
    model_of = docs.sparkSession.sparkContext.broadcast(train(table) if table else default_model())
    (t,) = fresh(docs, "text")
    kind = DataType.fromDDL("array<struct<kind:string,start:long,end:long>>")
    schema = docs.select(*rest).schema.add("base", kind).add("spans", kind)
    return docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).alias(t)).mapInArrow(_find(model_of), schema)
